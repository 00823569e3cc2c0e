"""Greedy decoding of event sequences over transition counts.

The original decodes a sequence from the client's vector and lays it beside
the true one. Here the decoder is the transition table of a field: from the
last known value the most frequent next one is taken (ties: the smallest),
``steps`` times. A path depends on its first value only, so what moves forward
is the set of distinct first values: one equi-join with the best-successor
table a step, the prefix kept. Clients meet their path once, at the end. No
step is larger than the catalogue, however many clients stand on one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .next_item import successors
from .ordering import newest

#: Distinct first values whose paths are broadcast; more are joined by a shuffle.
FEW_STARTS = 100_000


def best_successors(long: DataFrame, field: str, pos: str = "pos") -> DataFrame:
    """``(prev, next)``: the most frequent next value of every value that has one (ties: the smallest)."""
    counts = successors(long, field, pos)
    best = counts.groupBy("prev").agg(F.min(F.struct((-F.col("count")).alias("n"), F.col("next"))).alias("_b"))
    return best.select("prev", F.col("_b.next").alias("next"))


def greedy_paths(starts: DataFrame, best: DataFrame, steps: int) -> DataFrame:
    """``(start, path)`` for the distinct values of the one column of ``starts``: an array of ``steps`` values, null
    from where a value has no successor."""
    start = starts.columns[0]
    kind = best.schema["next"].dataType
    best = cut_lineage(best)
    paths = starts.select(F.col(start).alias("start")).where(F.col("start").isNotNull()).distinct() \
        .withColumn("_at", F.col("start").cast(kind)).withColumn("path", F.array().cast(f"array<{kind.simpleString()}>"))
    for _ in range(steps):
        paths = paths.join(best, paths["_at"] == best["prev"], "left").select(
            "start", F.col("next").alias("_at"), F.concat("path", F.array("next")).alias("path"))
    return paths.select("start", "path")


def hold_out(long: DataFrame, steps: int, pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """The rows before each client's last ``steps`` ones, and its last ``steps + 1`` rows with ``step`` (0 is the last
    known row, 1 to ``steps`` are held out; a client with fewer rows has no row of step 0)."""
    ends = long.groupBy("client_id").agg(F.max(pos).alias("_end"))
    known = long.join(ends, "client_id").where(F.col(pos) <= F.col("_end") - steps).drop("_end")
    tail = newest(long, "client_id", [pos], steps + 1, pos="_p", rev="_rev")
    return known, tail.withColumn("step", (F.lit(steps) - F.col("_rev")).cast("long")).drop("_p", "_rev")


def decode_greedy(long: DataFrame, fields, steps: int = 5, pos: str = "pos") -> DataFrame:
    """``(client_id, step, <field>, <field>_true ...)``: for every client with more than ``steps`` rows the decoded
    values of steps 1 to ``steps`` beside the true ones. The transition tables are fitted without the held-out rows."""
    fields = list(fields)
    known, tail = hold_out(long, steps, pos)
    known, tail = cut_lineage(known), cut_lineage(tail)
    decoded = tail.where("step = 0").select("client_id", *fields)
    for f in fields:
        paths = cut_lineage(greedy_paths(decoded.select(f), best_successors(known, f, pos), steps))
        if paths.count() <= FEW_STARTS:                     # few values: a join by value would have as few tasks
            paths = F.broadcast(paths)
        decoded = decoded.join(paths.withColumnsRenamed({"start": f, "path": f"_{f}"}), f, "left").drop(f)
    rows = decoded.select("client_id", F.posexplode(F.arrays_zip(*[f"_{f}" for f in fields])).alias("_i", "_z")).select(
        "client_id", (F.col("_i") + 1).cast("long").alias("step"), *[F.col(f"_z._{f}").alias(f) for f in fields])
    true = tail.where("step > 0").select("client_id", "step", *[F.col(f).alias(f"{f}_true") for f in fields])
    return rows.join(true, ["client_id", "step"])
