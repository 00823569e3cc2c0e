"""Imports every query module so that each registers its queries."""

from . import q_enc, q_factors, q_io, q_next, q_seq, q_stats, q_text, q_vec, q_vocab  # noqa: F401
