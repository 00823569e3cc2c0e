"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that one output batch of a Python stage covers at most (a longer text makes a batch of its own).
SLICE_CHARS = 2_000_000

#: Word separators of every operator here: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_GAP = re.compile(rb"[\x20\x09-\x0D]")


def others(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """The columns of ``df`` but those that an operator is about to write (names compare without case)."""
    taken = {n.lower() for n in names}
    return [df[f"`{c}`"] for c in df.columns if c.lower() not in taken]


def text_input(df: DataFrame, text: str, new: Sequence[str], keep_text: bool) -> tuple[DataFrame, list[str], str]:
    """What a Python stage reads of ``df``: its columns but ``new``; the names of those that it passes on; and the name
    that the text column has there. A text that is not kept does not travel back to Spark."""
    if keep_text:
        src = df.select(*others(df, new))
        return src, src.columns, next(c for c in src.columns if c.lower() == text.lower())
    rest = df.select(*others(df, [*new, text, "__text"]))
    return df.select(*others(df, [*new, text, "__text"]), df[f"`{text}`"].cast("string").alias("__text")), \
        rest.columns, "__text"


def with_fields(df: DataFrame, names: Sequence[str], new: dict[str, T.DataType]) -> T.StructType:
    """Schema of the columns ``names`` of ``df`` and the new ones."""
    return T.StructType([df.schema[c] for c in names] + [T.StructField(c, t) for c, t in new.items()])


def slices(pdf: pd.DataFrame, column: str, limit: int = SLICE_CHARS) -> Iterator[pd.DataFrame]:
    """Cut a batch into runs of rows of about ``limit`` characters, so that what a Python worker holds stays bounded."""
    sizes = pdf[column].map(lambda x: len(x) if x is not None else 0).to_numpy(dtype="int64")
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield pdf.iloc[start:i]
            start, held = i, 0
        held += n
    if start < len(pdf):
        yield pdf.iloc[start:]


def byte_blocks(data: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """Cut bytes at word separators into blocks of about ``size`` (a longer word stays whole)."""
    at = 0
    while at < len(data):
        if len(data) - at <= size:
            yield data[at:]
            return
        cut = _GAP.search(data, at + size)
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


def fold(column: str, modulus: int) -> Column:
    """``crc32(text of the id) mod modulus``; null ids fall into the fold of the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def fold_of(value: object, modulus: int) -> int:
    return zlib.crc32(str(value).encode()) % modulus


def hashed_sample(rows: DataFrame, group: str, key: str, limit: int) -> DataFrame:
    """Of each group the ``limit`` rows of smallest hash of ``key``, with ``place`` (from 1) in that order.

    Groups are few (classes); rows far above the place that the ``limit``-th is expected at are left out in their own
    task, so what meets in a group's window is bounded whatever the input."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("__n"))
    share = F.shiftrightunsigned(F.xxhash64(key), 11) / float(1 << 53)
    near = rows.withColumn("__share", share).join(F.broadcast(sizes), group) \
        .where(F.col("__share") * F.col("__n") < 2 * limit + 64)
    order = Window.partitionBy(group).orderBy("__share", key)
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("__share", "__n")


def words_of(text: Column) -> Column:
    """Native word array (null text: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def met(rows: DataFrame, once: DataFrame, on: Sequence[str], spread: Sequence[str], n: str = "n", parts: int = 1000,
        salts: int = 64) -> DataFrame:
    """Inner join of ``rows`` with ``once``, which has one row per key and says in ``n`` how many rows the key has.

    Keys with a ``parts``-th of all rows or more, of which there are at most ``parts``, come by broadcast; their rows
    are then spread by ``spread`` over the shuffle that all rows take, so no task gets a common key whole."""
    total = once.agg(F.sum(n)).first()[0] or 0
    more = F.struct(*[F.col(c) for c in once.columns if c not in (*on, n)], F.lit(True).alias("__met"))
    heavy = F.col(n) * parts >= total
    known = rows.join(F.broadcast(once.where(heavy).select(*on, more.alias("__heavy"))), list(on), "left")
    known = known.withColumn("__salt", F.when(F.col("__heavy").isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(*spread), F.lit(salts - 1)).cast("int") + 1))
    light = once.where(~heavy).select(*on, more.alias("__light"), F.lit(0).alias("__salt"))
    return known.join(light, [*on, "__salt"], "left").withColumn("__found", F.coalesce("__heavy", "__light")) \
        .where("__found is not null").select(*rows.columns, "__found.*").drop("__met")
