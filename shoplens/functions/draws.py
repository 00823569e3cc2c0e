"""Seeded draws that any SQL engine can repeat: the first 15 hex digits of an MD5, read as a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(key: Column | str, seed: int) -> Column:
    """A number in [0, 16^15) that depends on the key's text and the seed only."""
    k = F.col(key) if isinstance(key, str) else key
    digits = F.substring(F.md5(F.concat_ws(":", k.cast("string"), F.lit(str(seed))).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def draw_sql(key: str, seed: int) -> str:
    """The same number in DuckDB."""
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 15) AS BIGINT)"
