"""Next-item recommendation from transition counts.

The original trains sequence transformers to score every item after a
client's history. Here the same contract — top-k items per client, seen
items optionally filtered, one score per item — is served by first-order
transition counts:

* successors: ``(prev, next, count)`` from consecutive events, found by a
  self-join on ``(client, pos + 1)`` — no per-client window, so a hot client
  is spread over the join's hash partitions;
* a client's candidates are the successors of its last item, minus the
  items it has seen (anti join), ranked by count, then item; it asks only for
  the successor ranks it can need (k + its number of seen items), so a hot
  item's fan-out is never paired with every client that ends on it;
* fewer than ``k`` candidates are topped up with the globally most popular
  items that are neither seen nor chosen, picked exactly by walking the
  excluded popularity ranks (no client × item product).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..session import cut_lineage
from .ordering import global_ranks, group_ranks, positions


def successors(long: DataFrame, item: str = "item", pos: str = "pos") -> DataFrame:
    """K7 fit: ``(prev, next, count)`` over consecutive events of every client."""
    a = long.select("client_id", F.col(pos).alias("_p"), F.col(item).alias("prev"))
    b = long.select("client_id", (F.col(pos) - 1).alias("_p"), F.col(item).alias("next"))
    pairs = a.join(b, ["client_id", "_p"], "inner")
    return pairs.groupBy("prev", "next").agg(F.count(F.lit(1)).alias("count"))


def popularity(long: DataFrame, item: str = "item") -> DataFrame:
    """``(item, count, pop_rank)``: events per item, ranked 1.. by count desc then item.

    A global rank without a single-task window over the catalogue (see
    :func:`ordering.global_ranks`); items of any type."""
    counts = long.groupBy(item).agg(F.count(F.lit(1)).alias("count"))
    ranked = global_ranks(counts, [F.col("count").desc(), F.col(item).asc()], "_p")
    return ranked.select(item, "count", (F.col("_p") + 1).cast("long").alias("pop_rank"))


def last_items(long: DataFrame, item: str = "item", pos: str = "pos") -> DataFrame:
    """``(client_id, last)``: the newest event's item (a max_by aggregate, skew-safe)."""
    return long.groupBy("client_id").agg(F.max_by(item, pos).alias("last"))


def recommend(history: DataFrame, k: int = 10, filter_seen: bool = True, item: str = "item",
              pos: str = "pos", succ: DataFrame | None = None, pop: DataFrame | None = None) -> DataFrame:
    """K7 + T3 + T4 + K11: ``(user_id, item_id, prediction, rank)``, ``rank`` 1..k.

    ``prediction`` is the transition count for successor picks and 0 for
    popularity top-ups (which always rank after successor picks).
    """
    succ = succ if succ is not None else successors(history, item, pos)
    pop = pop if pop is not None else popularity(history, item)
    last = last_items(history, item, pos)
    seen = history.select("client_id", F.col(item).alias("item_id")).distinct()

    # Successors ranked per previous item (count desc, item asc). A client needs at
    # most its top k + |seen| ranks (seen items are the only ones dropped), so it
    # asks for exactly those rank numbers: an equi-join on (prev, rank) whose output
    # is bounded by the client's history + k, never clients × fan-out of a hot item.
    # All successors are ranked in one sort by ranges, so a hot page, however long its tail of equal counts, is spread.
    ranked_succ = group_ranks(succ, "prev", [F.col("count").desc(), F.col("next").asc()], "_p") \
        .withColumn("_r", F.col("_p") + 1).drop("_p")
    if filter_seen:
        n_seen = seen.groupBy("client_id").agg(F.count(F.lit(1)).alias("_s"))
        want = last.join(n_seen, "client_id", "left").select(
            "client_id", "last", (F.lit(k) + F.coalesce(F.col("_s"), F.lit(0))).alias("_want"))
        # no client asks for more ranks than its last item has successors
        fan_out = succ.groupBy("prev").agg(F.count(F.lit(1)).alias("_f"))
        want = want.join(fan_out, want["last"] == fan_out["prev"]).select(
            "client_id", "last", F.least("_want", "_f").alias("_want"))
    else:
        want = last.select("client_id", "last", F.lit(k).alias("_want"))
    asks = want.select("client_id", F.col("last").alias("prev"),
                       F.explode(F.sequence(F.lit(1), F.col("_want"))).alias("_r"))
    cand = asks.join(ranked_succ, ["prev", "_r"], "inner").select(
        "client_id", F.col("next").alias("item_id"), F.col("count").cast("double").alias("prediction"), "_r")
    if filter_seen:
        cand = cand.join(seen, ["client_id", "item_id"], "left_anti")
    w = Window.partitionBy("client_id").orderBy(F.col("_r").asc())
    top = cut_lineage(cand.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
                      .drop("_r"))                          # read by the top-up (three times) and by the result

    # top-up: the j-th popular item that is neither seen nor chosen
    n_top = top.groupBy("client_id").agg(F.count(F.lit(1)).alias("_n"))
    need = last.select("client_id").join(n_top, "client_id", "left").select(
        "client_id", (F.lit(k) - F.coalesce(F.col("_n"), F.lit(0))).alias("_need")).where(F.col("_need") > 0)
    excluded = top.select("client_id", "item_id")
    if filter_seen:
        excluded = excluded.unionByName(seen)
    excl = (excluded.join(need.select("client_id"), "client_id", "left_semi").distinct()
            .join(pop.select(F.col(item).alias("item_id"), "pop_rank"), "item_id", "inner"))
    # g = rank - (number of excluded ranks below it): only g <= k matters; its histogram is <= k rows/client
    ranked = positions(excl, "client_id", ["pop_rank"], pos="_pe",
                       bucket=F.shiftright(F.col("pop_rank"), 12))
    hist = (ranked.select("client_id", (F.col("pop_rank") - F.col("_pe")).alias("_g"))
            .where(F.col("_g") <= k).groupBy("client_id", "_g").agg(F.count(F.lit(1)).alias("_c"))
            .groupBy("client_id").agg(F.collect_list(F.struct("_g", "_c")).alias("_h")))
    n_items = pop.agg(F.max("pop_rank").alias("_K"))
    fill = (need.join(hist, "client_id", "left").crossJoin(F.broadcast(n_items))
            .select("client_id", "_K", F.posexplode(F.sequence(F.lit(1), F.col("_need"))).alias("_j0", "_j"), "_h"))
    hist_count = F.aggregate(F.coalesce(F.col("_h"), F.array().cast("array<struct<_g:long,_c:long>>")),
                             F.lit(0).cast("long"),
                             lambda acc, h: acc + F.when(h["_g"] <= F.col("_j"), h["_c"]).otherwise(0))
    fill = fill.select("client_id", F.col("_j0"), (F.col("_j") + hist_count).alias("pop_rank"), "_K") \
        .where(F.col("pop_rank") <= F.col("_K"))
    fill = fill.join(pop.select(F.col(item).alias("item_id"), "pop_rank"), "pop_rank", "inner")
    fill = (fill.join(n_top, "client_id", "left")
            .select(F.col("client_id"), "item_id", F.lit(0.0).alias("prediction"),
                    (F.coalesce(F.col("_n"), F.lit(0)) + F.col("_j0") + 1).cast("long").alias("rank")))
    recs = top.unionByName(fill)
    return recs.select(F.col("client_id").alias("user_id"), "item_id", "prediction", "rank")


def recs_to_rows(recs: DataFrame) -> DataFrame:
    """One row per user, ``items`` and ``scores`` arrays in rank order (bounded by k)."""
    g = recs.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "prediction"))).alias("_r"))
    return g.select("user_id", F.transform("_r", lambda x: x["item_id"]).alias("items"),
                    F.transform("_r", lambda x: x["prediction"]).alias("scores"))


def rows_to_recs(rows: DataFrame) -> DataFrame:
    """Back to long ``(user_id, item_id, prediction, rank)``."""
    z = rows.select("user_id", F.posexplode(F.arrays_zip("items", "scores")).alias("_i", "_z"))
    return z.select("user_id", F.col("_z")["items"].alias("item_id"), F.col("_z")["scores"].alias("prediction"),
                    (F.col("_i") + 1).cast("long").alias("rank"))


def next_value(history: DataFrame, item: str, value: str, pos: str = "pos") -> DataFrame:
    """K8: predicted next value (e.g. price) per client — the mean value of the
    successors of its last item, weighted by transition counts; the global mean
    of ``value`` when its last item has no successor."""
    a = history.select("client_id", F.col(pos).alias("_p"), F.col(item).alias("prev"))
    b = history.select("client_id", (F.col(pos) - 1).alias("_p"), F.col(value).alias("_v"))
    per_prev = a.join(b, ["client_id", "_p"]).groupBy("prev").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    glob = history.agg(F.avg(F.col(value).cast("double")).alias("_g"))
    last = last_items(history, item, pos)
    out = last.join(per_prev, last["last"] == per_prev["prev"], "left").crossJoin(F.broadcast(glob))
    return out.select("client_id", F.coalesce("_m", "_g").alias("prediction"))


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str = "client_id") -> DataFrame:
    """T5: a reproducible random sample of ``n`` rows (order by a seeded draw; the limit is the feature)."""
    return df.orderBy(draw(key, seed), F.col(key)).limit(n)
