"""Embedding-table operators and the merge pipeline.

An embedding table is ``(client_id LONG, embedding ARRAY<FLOAT|DOUBLE>)``
with one row per client and one width. Missing values are nulls inside
arrays (NaN in the original).

Row-local steps (sanitize, L2 normalization, completion, imputation) are
array expressions that stay inside whole-stage codegen. Steps that must be
fitted (PCA, quantiles, means) fit a model whose size is bounded by the
vector width (d × d covariance, d × 1000 quantile grid, d means), never by
the number of clients.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import bound
from ..session import cut_lineage
from ..sources.inputs import relevant_only

#: Fixed values of the quantile transform: at most this many quantiles, as in
#: the original scaler's default.
N_QUANTILES = 1000
#: Values this close to the smallest / largest quantile map to exactly 0 / 1.
BOUNDS_THRESHOLD = 1e-7


def _emb(c: str = "embedding") -> Column:
    return F.col(c)


# ---- row-local ------------------------------------------------------------------------

def sanitize(df: DataFrame, drop_zeros: bool = True) -> DataFrame:
    """Drop all-zero vectors (they mark "missing"); keep them when asked."""
    if not drop_zeros:
        return df
    return df.where(F.exists(_emb(), lambda x: x != 0))


def l2_normalize(df: DataFrame) -> DataFrame:
    """V5: ``x / ||x||_2`` per row; zero rows stay zero. The length is computed once a row, not for each number."""
    norm = F.sqrt(F.aggregate(_emb(), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return df.withColumn("embedding", bound(norm, lambda n: F.transform(
        _emb(), lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))))


def complete(df: DataFrame, relevant: DataFrame, width: int | Column | None = None,
             fill: float | None = 0.0) -> DataFrame:
    """Restrict to relevant clients and add the missing ones, filled with
    ``fill`` (``None`` → nulls, the NaN of the original)."""
    if width is None:
        w = df.agg(F.max(F.size("embedding")).alias("_w"))
        width = F.col("_w")
    else:
        w = None
    kept = relevant_only(df, relevant)
    out = relevant.select("client_id").join(kept, "client_id", "left")
    if w is not None:
        out = out.crossJoin(F.broadcast(w))
    filler = F.array_repeat(F.lit(fill).cast("double"), width if isinstance(width, Column) else F.lit(width))
    out = out.select("client_id", F.coalesce(F.col("embedding").cast("array<double>"), filler).alias("embedding"))
    return out


def impute_constant(df: DataFrame, value: float = 0.0) -> DataFrame:
    """V9 (constant): nulls → ``value``."""
    return df.withColumn("embedding", F.transform(_emb(), lambda x: F.coalesce(x.cast("double"), F.lit(value))))


def column_means(df: DataFrame) -> DataFrame:
    """One row, ``_means ARRAY<DOUBLE>``: mean of every position over non-null values.

    Long form → ``groupBy(pos)`` with map-side partial averages; the result
    has one entry per position (bounded by the width)."""
    longf = df.select(F.posexplode(_emb()).alias("_pos", "_x"))
    means = longf.groupBy("_pos").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_m"))),
                                 lambda s: s["_m"]).alias("_means"))


def impute_mean(df: DataFrame) -> DataFrame:
    """V9 (mean): nulls → the mean of their position (over the rows given)."""
    m = column_means(df)
    out = df.crossJoin(F.broadcast(m))
    return out.select("client_id", F.zip_with(_emb(), "_means", lambda x, mu: F.coalesce(x.cast("double"), mu))
                      .alias("embedding"))


# ---- fitted scalers -------------------------------------------------------------------

def quantile_grid(df: DataFrame, n_quantiles: int = N_QUANTILES, ranges: int = 256) -> list[np.ndarray]:
    """Per-position quantile grid (the fitted state of :func:`quantile_transform`).

    ``m = min(n_quantiles, n)`` evenly spaced quantiles of each position, as
    linearly interpolated exact order statistics. Equal values are counted
    together first; the distinct values are ranked inside about ``ranges``
    value ranges of each position, with the counts of the lower ranges added.
    The edges decide how evenly the work is dealt; they are approximate and
    differ from one evaluation to the next, so they are written once and every
    reader takes the same ones. A row with
    global ranks ``[a, b]`` then yields the quantiles whose lower or upper
    neighbour it is, by integer arithmetic. Collected: 2 x width x m rows.
    """
    cells = df.select(F.posexplode(_emb()).alias("_pos", "_x")).select(
        "_pos", (F.col("_x").cast("double") + F.lit(0.0)).alias("_x")).where(F.col("_x").isNotNull())
    counted = cut_lineage(cells.groupBy("_pos", "_x").agg(F.count(F.lit(1)).alias("_n")))
    probs = [i / ranges for i in range(1, ranges)]
    cuts = cut_lineage(counted.groupBy("_pos").agg(F.percentile_approx("_x", probs, 1000).alias("_cuts"),
                                                   F.sum("_n").alias("_rows")))
    dealt = counted.join(F.broadcast(cuts), "_pos") \
        .withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_x")))).drop("_cuts")
    sizes = dealt.groupBy("_pos", "_range").agg(F.sum("_n").alias("_size"))
    lower = Window.partitionBy("_pos").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_pos", "_range", F.coalesce(F.sum("_size").over(lower), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_pos", "_range").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.withColumn("_through", F.sum("_n").over(inside)).join(first, ["_pos", "_range"]).select(
        "_pos", "_x", "_rows", (F.col("_first") + F.col("_through") - F.col("_n")).alias("a"),
        (F.col("_first") + F.col("_through") - 1).alias("b"),
        (F.least(F.col("_rows"), F.lit(n_quantiles)) - 1).alias("s"), (F.col("_rows") - 1).alias("g"))
    # quantile k lies at rank k * g / s: its lower neighbour has rank floor(k * g / s), the upper one ceil
    low = F.expr("""if(g = 0, sequence(0L, 0L), if((a * s + g - 1) div g <= ((b + 1) * s + g - 1) div g - 1,
                    sequence((a * s + g - 1) div g, least(s, ((b + 1) * s + g - 1) div g - 1)), cast(array() as array<long>)))""")
    high = F.expr("""if(g = 0, sequence(0L, 0L), if(if(a = 0, 0L, (a - 1) * s div g + 1) <= b * s div g,
                     sequence(if(a = 0, 0L, (a - 1) * s div g + 1), b * s div g), cast(array() as array<long>)))""")
    picked = ranked.select("_pos", "_x", "_rows", F.explode(low).alias("k"), F.lit(0).alias("side")).unionByName(
        ranked.select("_pos", "_x", "_rows", F.explode(high).alias("k"), F.lit(1).alias("side")))
    found: dict[int, tuple[int, dict[tuple[int, int], float]]] = {}
    for pos, x, rows, k, side in picked.toPandas().itertuples(index=False, name=None):
        found.setdefault(pos, (rows, {}))[1][side, k] = x
    grid = []
    for pos in sorted(found):
        n, at = found[pos]
        m = min(n_quantiles, n)
        rank = [(k * (n - 1) / (m - 1) if m > 1 else 0.0) for k in range(m)]
        part = np.array([t - (k * (n - 1) // (m - 1) if m > 1 else 0) for k, t in enumerate(rank)])
        lo = np.array([at[0, k] for k in range(m)])
        hi = np.array([at[1, k] for k in range(m)])
        if not np.isfinite(lo).all() or not np.isfinite(hi).all():
            raise ValueError(f"quantiles of position {pos}: values must be finite")
        grid.append(lo + (hi - lo) * part)
    return grid


def _two_sided(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Share of the grid below ``x``: the mean of the places of the last grid point not above it and of the first
    not below it, each moved by linear interpolation; the smallest value → 0, the largest → 1."""
    if len(q) == 1:
        return np.zeros_like(x)
    last = np.searchsorted(q, x, side="right") - 1
    next_ = np.searchsorted(q, x, side="left")
    lo, hi = np.clip(last, 0, len(q) - 1), np.clip(next_, 0, len(q) - 1)
    gap = q[hi] - q[lo]
    between = last < next_                                  # x lies strictly between two points
    share = np.where(between, lo + np.divide(x - q[lo], gap, out=np.zeros_like(x), where=gap > 0), (lo + hi) / 2)
    y = share / (len(q) - 1)
    y = np.where(x + BOUNDS_THRESHOLD > q[-1], 1.0, y)
    return np.where(x - BOUNDS_THRESHOLD < q[0], 0.0, y)


def quantile_transform(df: DataFrame, grid: list[np.ndarray] | None = None) -> DataFrame:
    """V6: every position mapped to its quantile in [0, 1].

    Fitting is :func:`quantile_grid`; the transform is an Arrow-batched
    ``mapInPandas`` (``np.interp`` per position), the one place where a
    vectorized Python step beats a per-cell SQL search over 1,000 points.
    """
    grid = grid if grid is not None else quantile_grid(df)
    bc = df.sparkSession.sparkContext.broadcast([g.tolist() for g in grid])
    schema = T.StructType([T.StructField("client_id", T.LongType()),
                           T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def apply(batches):
        import pandas as pd
        qs = [np.asarray(g, dtype="float64") for g in bc.value]
        for pdf in batches:
            if len(pdf) == 0:
                continue
            m = np.vstack([np.asarray(v, dtype="float64") for v in pdf["embedding"]])
            out = np.empty_like(m)
            for j, q in enumerate(qs):
                out[:, j] = _two_sided(m[:, j], q)
            yield pd.DataFrame({"client_id": pdf["client_id"].astype("int64"), "embedding": list(out)})

    return df.select(F.col("client_id").cast("long"), F.col("embedding").cast("array<double>")) \
        .mapInPandas(apply, schema)


def scale_global_standard(df: DataFrame) -> DataFrame:
    """V7 (global): one standard scaler over ALL cells (mean 0, population std 1)."""
    cells = df.select(F.explode(_emb()).alias("_x"))
    stats = cells.agg(F.avg(F.col("_x").cast("double")).alias("_mu"),
                      F.stddev_pop(F.col("_x").cast("double")).alias("_sd"))
    out = df.crossJoin(F.broadcast(stats))
    sd = F.when(F.col("_sd") == 0, F.lit(1.0)).otherwise(F.col("_sd"))
    return out.select("client_id", F.transform(_emb(), lambda x: (x.cast("double") - F.col("_mu")) / sd)
                      .alias("embedding"))


def pca_fit(df: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """V4 fit: ``(mean[d], components[d, k])`` of the rows' covariance.

    The covariance is two distributed JVM aggregates — ``Correlation`` (a
    tree aggregate of the Gramian) and ``Summarizer`` (mean, variance) — so
    only the d × d matrix reaches the driver, where numpy's symmetric eigen
    solver takes it apart. Signs are fixed so that each component's largest
    absolute loading is positive (deterministic, comparable up to sign).
    """
    mean, cov = covariance(df)
    return mean, top_components(cov, k)


def covariance(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and unbiased covariance of the rows (d and d × d numbers reach the driver)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation, Summarizer

    v = df.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("_v"))
    stats = v.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s")).first()["s"]
    mean = stats["mean"].toArray()
    var = stats["variance"].toArray()          # unbiased (n - 1), as the covariance below
    corr = Correlation.corr(v, "_v", "pearson").first()[0].toArray()
    sd = np.sqrt(np.clip(var, 0.0, None))
    cov = np.nan_to_num(corr) * np.outer(sd, sd)
    np.fill_diagonal(cov, var)
    return mean, cov


def covariance_rows(df: DataFrame) -> DataFrame:
    """``(pos, other, value)``: the covariance as a table."""
    _, cov = covariance(df)
    rows = [(i, j, float(x)) for i, line in enumerate(cov) for j, x in enumerate(line)]
    return df.sparkSession.createDataFrame(rows, "pos long, other long, value double")


def top_components(cov: np.ndarray, k: int) -> np.ndarray:
    """``components[d, k]``: eigenvectors of the ``k`` largest eigenvalues of a
    symmetric d × d matrix; each column's largest absolute loading is positive."""
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1][:k]
    comps = vecs[:, order]
    signs = np.where(comps[np.abs(comps).argmax(axis=0), np.arange(comps.shape[1])] < 0, -1.0, 1.0)
    return comps * signs


def project(df: DataFrame, mean: np.ndarray, comps: np.ndarray) -> DataFrame:
    """V4 transform: ``(x - mean) @ components`` on Arrow batches (one matmul per batch)."""
    bc = df.sparkSession.sparkContext.broadcast((mean.tolist(), comps.tolist()))
    schema = T.StructType([T.StructField("client_id", T.LongType()),
                           T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def apply(batches):
        import pandas as pd
        mu, w = (np.asarray(x, dtype="float64") for x in bc.value)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            m = np.vstack([np.asarray(v, dtype="float64") for v in pdf["embedding"]])
            yield pd.DataFrame({"client_id": pdf["client_id"].astype("int64"), "embedding": list((m - mu) @ w)})

    return df.select(F.col("client_id").cast("long"), F.col("embedding").cast("array<double>")) \
        .mapInPandas(apply, schema)


def pca(df: DataFrame, k: int) -> DataFrame:
    """V4: centre, then project on the top ``k`` principal components."""
    mean, comps = pca_fit(df, k)
    return project(df, mean, comps)


# ---- merge ----------------------------------------------------------------------------

def outer_merge(tables: list[DataFrame], names: list[str] | None = None) -> DataFrame:
    """Full outer alignment of k tables, missing blocks as nulls.

    One union in long form + one ``groupBy(client_id)`` instead of k full
    outer joins; each block's width comes from a one-row aggregate. A client
    with two rows in one table, or a table of mixed widths, fails the job; a
    table without rows contributes a block of width 0.
    """
    names = names or [f"table {i}" for i in range(len(tables))]
    u = reduce(lambda a, b: a.unionByName(b), [
        t.select(F.col("client_id").cast("long"), F.lit(i).alias("_b"),
                 F.col("embedding").cast("array<double>").alias("embedding"))
        for i, t in enumerate(tables)])
    widths, blocks, rows = [], [], []
    for i, name in enumerate(names):
        size = F.when(F.col("_b") == i, F.size("embedding"))
        widths.append(F.when(F.min(size) < F.max(size), F.raise_error(F.lit(f"mixed widths in {name}")).cast("int"))
                      .otherwise(F.coalesce(F.max(size), F.lit(0))).alias(f"_w{i}"))
        rows.append(F.count(size).alias(f"_n{i}"))
        rows.append(F.first(F.when(F.col("_b") == i, F.col("embedding")), ignorenulls=True).alias(f"_e{i}"))
        one = F.when(F.col(f"_n{i}") > 1, F.raise_error(F.concat(
            F.lit(f"client with several rows in {name}: "), F.col("client_id").cast("string"))).cast("array<double>"))
        blocks.append(one.otherwise(F.coalesce(
            F.col(f"_e{i}"), F.array_repeat(F.lit(None).cast("double"), F.col(f"_w{i}")))))
    g = u.groupBy("client_id").agg(*rows).crossJoin(F.broadcast(u.agg(*widths)))
    return g.select("client_id", F.concat(*blocks).alias("embedding"))


@dataclass
class TableSpec:
    """One table of the merge: its data, an optional processor and scaler (H1)."""

    name: str
    table: DataFrame
    processor: tuple | None = None        # ("pca", k)
    scaler: str | None = None             # "normalizer" | "quantile" | "global_standard"


PROCESSORS = {"pca": lambda df, k: pca(df, k)}
SCALERS = {
    "normalizer": l2_normalize,
    "quantile": quantile_transform,
    "global_standard": scale_global_standard,
}


#: Steps that fit a model on the table before transforming it (each reads it again).
FITTED = {"pca", "quantile", "global_standard"}


def prepare(spec: TableSpec, drop_zeros: bool = True) -> DataFrame:
    """V1 → V3 → V7 for one table.

    A table that feeds a fitted step is read by the fit and again by the
    transform; it is materialised once in the shared checkpoint folder so
    its upstream job (e.g. the 37 client statistics) runs once.
    """
    df = sanitize(spec.table, drop_zeros)
    steps = {spec.processor[0] if spec.processor else None, spec.scaler}
    if steps & FITTED:
        df = cut_lineage(df)
    if spec.processor is not None:
        name, arg = spec.processor
        df = PROCESSORS[name](df, arg)
    if spec.scaler is not None:
        df = SCALERS[spec.scaler](df)
    return df


def merge_all(specs: list[TableSpec], relevant: DataFrame | None = None, drop_zeros: bool = True,
              impute: str = "mean", drop_zeros_of: set[str] | None = None) -> DataFrame:
    """The merge pipeline: prepare each table, outer-merge, complete with the
    relevant clients (submit mode, missing → null), impute (mean or constant 0). ``drop_zeros_of`` names the tables
    whose zero vectors mean "missing" (default: all of them, or none without ``drop_zeros``)."""
    merged = outer_merge([prepare(s, drop_zeros and (drop_zeros_of is None or s.name in drop_zeros_of)) for s in specs],
                         [s.name for s in specs])
    if relevant is not None:
        merged = complete(merged, relevant, fill=None)
    if impute == "mean":
        # the means are a fit over the merged table: materialise it once (the
        # Python-side transforms above then run once, not per read)
        return impute_mean(cut_lineage(merged))
    if impute == "constant":
        return impute_constant(merged, 0.0)
    raise ValueError(f"unknown imputer {impute!r}")


def explode_vectors(df: DataFrame) -> DataFrame:
    """``(client_id, pos, value)`` long form for comparisons."""
    return df.select("client_id", F.posexplode("embedding").alias("pos", "value")).select(
        "client_id", F.col("pos").cast("long"), F.col("value").cast("double"))
