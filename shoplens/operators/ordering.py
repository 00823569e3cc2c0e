"""Skew-safe positions inside groups (W1, T1) and bounded array views.

``row_number() OVER (PARTITION BY client ORDER BY ts)`` sends all events of
one client to one task; if one client holds a third of the data, that task
does a third of the work. ``positions`` ranks keys of at most ``MANY_ROWS``
rows that way, in partitions whose number rises with the rows, and splits the
others into calendar buckets (by default the hour of the first order column):

* rows are ranked inside ``(key, bucket)`` — a hot client is spread over as
  many tasks as it has active hours;
* a small ``(key, bucket, count)`` table, pre-aggregated map-side, gives the
  number of the key's rows in earlier buckets (its window per key holds one
  row per bucket, bounded by the calendar span);
* position = rows before the bucket + rank inside the bucket.

Deterministic (no sampled range bounds, no row ids), no collect.
"""

from __future__ import annotations



from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_NULL_BUCKET = -(2 ** 62)
#: Keys with more rows are ranked by buckets.
MANY_ROWS = 10_000
#: Rows that a task sorts.
ROWS_A_TASK = 250_000
#: Groups whose first ranks are broadcast.
FEW_GROUPS = 100_000


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def hour_bucket(time: Column) -> Column:
    """The hour of a timestamp as a number that rises with it; nulls get the lowest."""
    return F.coalesce(F.floor(F.unix_timestamp(time) / 3600).cast("long"), F.lit(_NULL_BUCKET))


def positions(df: DataFrame, key: str, order: list, pos: str = "pos",
              rev: str | None = None, length: str | None = None,
              bucket: Column | None = None, materialize: bool = True, size: str | None = None,
              many: int | None = None) -> DataFrame:
    """Add the 0-based position of each row inside ``key`` by ``order`` (rows without a key are left out).

    ``order`` must be a total order within a key for a deterministic result
    (rows equal on every order column must be equal on every output column).
    ``bucket`` must be monotone in ``order`` (default: the hour of the first
    order column). Optional ``rev``: position from the end; ``length``: rows
    of the key. With ``size`` (a column of numbers above 0) a row stands for
    that many places and its position is the first of them.

    The input is written to the shared checkpoint folder once; keys of at
    most ``many`` rows (default ``MANY_ROWS``) are ranked in one window each,
    the others by :func:`_bucket_positions`. The result is written too, so
    consumers that use the positions several times neither recompute nor
    re-plan them. Without ``materialize`` nothing is written, and all keys
    are ranked by buckets.
    """
    order_cols = _cols(order)
    if bucket is None:
        bucket = hour_bucket(order_cols[0])
    if not materialize:
        return _bucket_positions(df, key, order_cols, bucket, size, pos, rev, length)
    many = MANY_ROWS if many is None else many
    rows = cut_lineage(df.where(F.col(key).isNotNull() & bucket.isNotNull()))
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // ROWS_A_TASK))
    heavy = cut_lineage(sizes.where(F.col("_n") > many).select(key)) if (most or 0) > many else None
    w = Window.partitionBy(key)
    short = (rows if heavy is None else rows.join(heavy, key, "left_anti").select(*rows.columns)).repartition(parts, key)
    rank, count = _places(w, w.orderBy(*order_cols), size)
    out = short.withColumn("_at", rank).withColumn("_len", count)
    out = _named(out, F.col("_at"), pos, rev, length).drop("_at", "_len")
    if heavy is not None:
        dealt = rows.join(heavy, key, "left_semi").select(*rows.columns)
        out = out.unionByName(_bucket_positions(dealt, key, order_cols, bucket, size, pos, rev, length))
    return cut_lineage(out)


def _places(w, inside, size: str | None) -> tuple[Column, Column]:
    """Places before a row in the ordered window, and places of the whole window."""
    if size is None:
        return F.row_number().over(inside) - 1, F.count(F.lit(1)).over(w)
    before = F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(before, F.lit(0)), F.sum(size).over(w)


def _named(df: DataFrame, at: Column, pos: str, rev: str | None, length: str | None) -> DataFrame:
    out = df.withColumn(pos, at.cast("long"))
    if rev:
        out = out.withColumn(rev, (F.col("_len") - 1 - F.col(pos)).cast("long"))
    if length:
        out = out.withColumn(length, F.col("_len").cast("long"))
    return out


def _bucket_positions(df: DataFrame, key: str, order_cols: list[Column], bucket: Column, size: str | None, pos: str,
                      rev: str | None, length: str | None) -> DataFrame:
    """:func:`positions` by buckets, however many rows a key has: rank and bucket size come from two windows over one
    ``(key, bucket)`` exchange; what lies before a bucket from a window over a key's buckets."""
    wb = Window.partitionBy(key, "_bkt")
    rank, count = _places(wb, wb.orderBy(*order_cols), size)
    ranked = df.withColumn("_bkt", bucket).withColumn("_rn", rank).withColumn("_cnt", count)
    wk = Window.partitionBy(key).orderBy("_bkt")
    counts = ranked.where(F.col("_rn") == 0).select(
        key, "_bkt",
        F.coalesce(F.sum("_cnt").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_cnt").over(Window.partitionBy(key)).alias("_len"),
    )
    out = _named(ranked.join(counts, [key, "_bkt"], "inner"), F.col("_before") + F.col("_rn"), pos, rev, length)
    return out.drop("_bkt", "_rn", "_cnt", "_before", "_len")


def newest(df: DataFrame, key: str, order: list, n: int, pos: str = "pos", rev: str | None = None) -> DataFrame:
    """The newest ``n`` rows of each key, with a position that rises with ``order`` (the newest row has -1) and, on
    demand, ``rev`` from 0 for the newest.

    ``row_number() <= n`` plans as a window group limit: each map task keeps its newest ``n`` rows per key before the
    shuffle, so a hot key arrives bounded, and no table is written."""
    w = Window.partitionBy(key).orderBy(*[c.desc() for c in _cols(order)])
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    out = out.withColumn(pos, (-F.col("_rn")).cast("long"))
    if rev:
        out = out.withColumn(rev, (F.col("_rn") - 1).cast("long"))
    return out.drop("_rn")


def global_ranks(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Add the 0-based rank of every row by ``order`` (a total order of any sortable types) without one window over
    all rows: range partitions are sorted, numbered and written once, and a partition's first rank is the number of
    rows in the partitions before it (a window over as many rows as there are partitions)."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(sorted_.withColumn("_part", F.spark_partition_id())
                         .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return placed.join(F.broadcast(first), "_part").withColumn(rank, F.col("_first") + F.col("_at")) \
        .drop("_part", "_at", "_first")


def group_ranks(df: DataFrame, key: str, order: list[Column], rank: str = "rank") -> DataFrame:
    """Add the 0-based rank of every row inside ``key`` by ``order`` (a total order), however large the group: one sort
    by ranges over all rows, then a row's global rank minus the smallest of its group. No task holds a whole group."""
    ranked = global_ranks(df, [F.col(key).asc(), *order], "_rank")
    first = cut_lineage(ranked.groupBy(key).agg(F.min("_rank").alias("_low")))
    if first.count() <= FEW_GROUPS:                         # else a shuffled join, whose skewed side may be split
        first = F.broadcast(first)
    return ranked.join(first, key).withColumn(rank, F.col("_rank") - F.col("_low")).drop("_rank", "_low")


def collect_ordered(df: DataFrame, key: str, pos: str, fields: list[str],
                    last_n: int | None = None, rev: str | None = None) -> DataFrame:
    """One row per key with one array per field, ordered by ``pos``.

    With ``last_n`` (and the ``rev`` column from :func:`positions`) only the
    newest ``last_n`` rows are collected, which bounds the array size for a
    hot key. Without it the arrays hold the whole history of a key: use only
    where histories are bounded by construction.
    """
    src = df
    if last_n is not None:
        if rev is None:
            raise ValueError("last_n needs the reverse position column")
        src = src.where(F.col(rev) < last_n)
    packed = src.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos).alias("_p"), *[F.col(f) for f in fields]))).alias("_seq"))
    def field_of(f: str):
        return lambda x: x[f]
    return packed.select(key, *[F.transform("_seq", field_of(f)).alias(f) for f in fields])


def explode_arrays(df: DataFrame, key: str, fields: list[str], pos: str = "pos") -> DataFrame:
    """Long form ``(key, pos, field...)`` of aligned arrays (for comparisons)."""
    z = F.arrays_zip(*[F.col(f) for f in fields])
    return (df.select(key, F.posexplode(z).alias(pos, "_z"))
            .select(key, F.col(pos).cast("long").alias(pos), *[F.col("_z")[f].alias(f) for f in fields]))
