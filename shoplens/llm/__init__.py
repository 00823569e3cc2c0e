"""Operators for preparing training text: tokenising, packing, scanning, deduplicating, scoring and archiving."""
