"""Ranking and regression metrics (G1-G7, J10, M1, M2), each one aggregate row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import position_of
from ..session import cut_lineage


def ranking(recs: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """Hit rate @1 and @k, MRR@k, NDCG@k with one target per user.

    ``recs``: ``(user_id, item_id, rank)``; ``labels``: ``(user_id, item_id)``.
    Users are those with both recommendations and a label (inner, J10). Both sides of the joins are shuffled: the written
    recommendations are few bytes of parquet, by which Spark would hold all of them in the driver for a broadcast.
    """
    recs = cut_lineage(recs)                                 # read for the users and for the hits
    users = recs.select("user_id").distinct().hint("merge")
    lab = labels.select("user_id", F.col("item_id").alias("_t")).join(users, "user_id", "left_semi")
    hits = recs.where(F.col("rank") <= k).select("user_id", F.col("item_id").alias("_t"), "rank")
    j = lab.join(hits.hint("merge"), ["user_id", "_t"], "left")
    r = F.col("rank")
    return j.agg(
        F.count(F.lit(1)).alias("users"),
        F.avg(F.when(r == 1, 1.0).otherwise(0.0)).alias("hit_rate_1"),
        F.avg(F.when(r.isNotNull(), 1.0).otherwise(0.0)).alias(f"hit_rate_{k}"),
        F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias(f"mrr_{k}"),
        F.avg(F.coalesce(1.0 / F.log2(r + 1), F.lit(0.0))).alias(f"ndcg_{k}"),
    )


def ranking_rows(rows: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """G1-G4 on one row per user (K10): ``rows`` is ``(user_id, items)``, best first; the target's place in the array is
    its rank (R5), so recommendations are not exploded and only labels are joined."""
    j = labels.select("user_id", F.col("item_id").alias("_t")).join(rows.select("user_id", "items"), "user_id", "inner")
    place = position_of("items", "_t")
    r = j.select(F.when((place > 0) & (place <= k), place).alias("_r"))
    rank = F.col("_r")
    return r.agg(
        F.count(F.lit(1)).alias("users"),
        F.avg(F.when(rank == 1, 1.0).otherwise(0.0)).alias("hit_rate_1"),
        F.avg(F.when(rank.isNotNull(), 1.0).otherwise(0.0)).alias(f"hit_rate_{k}"),
        F.avg(F.coalesce(1.0 / rank, F.lit(0.0))).alias(f"mrr_{k}"),
        F.avg(F.coalesce(1.0 / F.log2(rank + 1), F.lit(0.0))).alias(f"ndcg_{k}"),
    )


def spearman(df: DataFrame, a: str, b: str) -> float:
    """Spearman correlation (ranks computed distributed by ``ml.stat.Correlation``)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation
    v = VectorAssembler(inputCols=[a, b], outputCol="_v").transform(
        df.select(F.col(a).cast("double").alias(a), F.col(b).cast("double").alias(b)))
    m = Correlation.corr(v, "_v", "spearman").first()[0]
    return float(m.toArray()[0, 1])


def numeric(preds: DataFrame, labels: DataFrame, key: str = "client_id", col: str = "value") -> DataFrame:
    """Spearman, MAE, RMSE and R² of ``prediction`` against ``{col}_true``."""
    j = cut_lineage(preds.join(labels, key, "inner").select(         # read by the ranks, the mean and the errors
        F.col("prediction").cast("double").alias("p"), F.col(f"{col}_true").cast("double").alias("t")))
    rho = spearman(j, "t", "p")
    mean_t = j.agg(F.avg("t").alias("_mt"))
    x = j.crossJoin(F.broadcast(mean_t))
    err = F.col("p") - F.col("t")
    return x.agg(
        F.count(F.lit(1)).alias("n"),
        F.lit(rho).alias(f"{col}_spearman"),
        F.avg(F.abs(err)).alias(f"{col}_mae"),
        F.sqrt(F.avg(err * err)).alias(f"{col}_rmse"),
        (F.lit(1.0) - F.sum(err * err) / F.sum(F.pow(F.col("t") - F.col("_mt"), 2))).alias(f"{col}_r2"),
    )
