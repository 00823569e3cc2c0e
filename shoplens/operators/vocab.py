"""Vocabularies, frequency filters and client splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from .ordering import global_ranks


def value_counts(df: DataFrame, col: str, out: str = "count") -> DataFrame:
    """Events per value, null values dropped (pre-aggregated map-side)."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out))


def top_values(df: DataFrame, col: str, n: int) -> DataFrame:
    """The ``n`` most frequent values, ties by value. Output bounded by ``n``."""
    return value_counts(df, col).orderBy(F.col("count").desc(), F.col(col).asc()).limit(n)


def dense_codes(df: DataFrame, col: str, start: int = 0, code: str = "code") -> DataFrame:
    """``(value, code)`` with codes ``start, start+1, ...`` in ascending value order.

    Any type of value: the distinct values are sorted by ranges and numbered
    from the sizes of the ranges before (see :func:`ordering.global_ranks`).
    """
    values = df.select(col).where(F.col(col).isNotNull()).distinct()
    ranked = global_ranks(values, [F.col(col).asc()], "_r")
    return ranked.select(col, (F.col("_r") + F.lit(start)).cast("long").alias(code))


def encode(df: DataFrame, mapping: DataFrame, col: str, code: str, new_col: str | None = None) -> DataFrame:
    """Replace ``col`` by its code (inner: values without a code are dropped)."""
    m = mapping.select(F.col(col).alias("_v"), F.col(code).alias("_code"))
    return df.join(m, df[col] == m["_v"], "inner").drop("_v", col).withColumnRenamed("_code", new_col or col)


def decode(df: DataFrame, mapping: DataFrame, col: str, code: str, code_col: str | None = None) -> DataFrame:
    """Map the codes of ``code_col`` back to values, in a column named ``col``."""
    c = code_col or code
    m = mapping.select(F.col(col).alias("_value"), F.col(code).alias("_code"))
    return df.join(m, df[c] == m["_code"], "left").drop("_code", c).withColumnRenamed("_value", col)


def _kept_codes(df: DataFrame, col: str, max_count: int, counts: DataFrame | None = None) -> DataFrame:
    """``(col, code)`` of the kept values only: at most ``max_count`` rows (a proven bound).

    Top ``max_count`` values by count (ties by value); 0 keeps code 0; kept
    non-zero values get 2, 3, ... in value order when some value falls out
    (1 is "other"), 1, 2, ... when none does.
    """
    counts = counts if counts is not None else value_counts(df, col, "_n")
    top = counts.orderBy(F.col("_n").desc(), F.col(col).asc()).limit(max_count).select(col)
    has_other = counts.agg((F.count(F.lit(1)) > max_count).cast("int").alias("_o"))
    w = Window.orderBy(col)  # over at most max_count rows
    ranked = (top.where(F.col(col) != 0).select(col, F.row_number().over(w).alias("_rank"))
              .crossJoin(F.broadcast(has_other))
              .select(col, (F.col("_rank") + F.col("_o")).alias("code")))
    zero = top.where(F.col(col) == 0).select(col, F.lit(0).alias("code"))
    return ranked.unionByName(zero).select(col, F.col("code").cast("long").alias("code"))


def capped_codes(df: DataFrame, col: str, max_count: int, counts: DataFrame | None = None) -> DataFrame:
    """``(value, code)`` for every distinct value of ``col``.

    Top ``max_count`` values by count (ties by value) keep a code, others
    become "other". 0 means absent and keeps code 0 if it is among the top;
    "other" is code 1 when anything falls out, and kept non-zero values get
    2, 3, ... in value order (1, 2, ... when nothing falls out).
    ``counts`` (``(col, _n)``, e.g. from :func:`multi_value_counts`) saves the scan of ``df``.
    """
    counts = counts if counts is not None else value_counts(df, col, "_n")
    kept = _kept_codes(df, col, max_count, counts)
    return (counts.select(col).join(F.broadcast(kept), col, "left")
            .select(col, F.coalesce(F.col("code"), F.lit(1)).cast("long").alias("code")))


def multi_value_counts(df: DataFrame, cols: list[str]) -> dict[str, DataFrame]:
    """A11 for several columns in ONE scan: ``{col: (col, _n)}``, null values dropped.

    Rows are exploded to ``(column index, value)`` and counted with one
    partial + final aggregate; each column's table is a filter of it.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("long").alias("_v"))
                                for i, c in enumerate(cols)]))
    counts = (df.select(pairs.alias("_p")).select("_p._c", "_p._v").where(F.col("_v").isNotNull())
              .groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("_n")))
    return {c: counts.where(F.col("_c") == i).select(F.col("_v").alias(c), "_n") for i, c in enumerate(cols)}


def apply_capped(df: DataFrame, col: str, max_count: int, counts: DataFrame | None = None) -> DataFrame:
    """E3 applied: replace ``col`` by its capped code (null stays null).

    Only the kept values (≤ ``max_count`` rows) are broadcast; every other
    value is "other" (1). The events are never shuffled by value, so a hot
    item costs nothing extra.
    """
    kept = _kept_codes(df, col, max_count, counts).select(F.col(col).alias("_v"), F.col("code").alias("_code"))
    out = df.join(F.broadcast(kept), df[col] == kept["_v"], "left")
    code = F.when(F.col(col).isNull(), F.lit(None)).otherwise(F.coalesce(F.col("_code"), F.lit(1))).cast("long")
    return out.withColumn(col, code).drop("_v", "_code")


def apply_capped_many(df: DataFrame, cols: list[str], max_count: int) -> DataFrame:
    """E3 on several columns: the vocabularies are fitted on ``df`` (one counting
    scan for all of them), then applied with one join each — the input is
    read twice in total, not twice per column."""
    counts = multi_value_counts(df, cols)
    out = df
    for c in cols:
        out = apply_capped(out, c, max_count, counts[c])
    return out


def min_count_items(df: DataFrame, item: str, min_count: int) -> DataFrame:
    """keep events whose item has at least ``min_count`` events."""
    keep = value_counts(df, item, "_n").where(F.col("_n") >= min_count).select(item)
    return df.join(keep, item, "left_semi")


def min_events_clients(df: DataFrame, min_events: int = 2, key: str = "client_id") -> DataFrame:
    """keep events of clients with at least ``min_events`` events."""
    keep = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_events).select(key)
    return df.join(keep, key, "left_semi")


def stage_report(df: DataFrame, distinct_cols: list[str]) -> DataFrame:
    """One row — row count and distinct counts of the given columns."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.count_distinct(c).alias(f"distinct_{c}") for c in distinct_cols])


def split_clients(df: DataFrame, test: float = 0.02, validation: float = 0.01,
                  seed: int = 42, key: str = "client_id") -> DataFrame:
    """``(client_id, part)`` with part in train / validation / test.

    Seeded draws are stable under repartitioning and re-runs; test first,
    then validation as a share of the rest, like the original split.
    """
    ids = df.select(key).distinct()
    t = draw(key, seed) % 10_000 < int(round(test * 10_000))
    v = draw(key, seed + 1) % 10_000 < int(round(validation * 10_000))
    part = F.when(t, "test").when(v, "validation").otherwise("train")
    return ids.select(key, part.alias("part"))
