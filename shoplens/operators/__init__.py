"""Operators: each module is one family of the inventory."""
