"""Embedding near-duplicates over an inverted multi-index.

Two codebooks, one per half of the unit vectors, cut the space into a product
grid. A vector is listed in its own cell and looks for partners in the cells
nearest to it, in the order of the multi-sequence walk (rising sum of the
distances to the two halves' centres). How many cells a walk visits is set on
a sample, so that the walks meet the target share of its true pairs. Every
meeting is verified by the cosine in double precision.

Equal vectors are one class with a weight from the start. A cell's members and
visitors are dealt out in blocks (``BLOCK``), each pair of blocks a group of
its own, so no task holds an unbounded cell. A block returns link counts per
vector and a spanning forest, never its pairs. A pair that only one side's
walk found is credited to the other side as well, which is told by the cells
that the other side visits.

Codebooks and walk length are fitted on the ``sample`` vectors of smallest
hash; all vectors are indexed and all are queries.

Rows: null, zero, empty or non-finite vectors, and vectors with null
components, link with nothing; vectors of different lengths do not link. A
null id takes part but names a component only if it has no other. Repeated
rows are copies and link with each other; very long vectors are compared whole;
of equal ids the component takes one. Empty tables give empty results. Input
columns may have any names: only the two that are named are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.session import cut_lineage

from .components import components, forest

#: Vectors of a block of a cell, and of a block of its visitors.
BLOCK = 2048
#: Vectors of a cell that the grid is sized for, and codewords of a half at most.
CELL = 512
MOST_WORDS = 1024


def unit(data: list[bytes], size: int, kind: str = "f8") -> np.ndarray:
    """Unit rows in double precision from packed vectors of numpy's ``kind`` (a single component gets a zero beside it,
    so that there are two halves)."""
    x = np.frombuffer(b"".join(data), kind).reshape(-1, size).astype(np.float64)
    if size == 1:
        x = np.concatenate([x, np.zeros_like(x)], axis=1)
    x = x / np.abs(x).max(axis=1, keepdims=True)            # no overflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _square_distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ words.T + (words * words).sum(axis=1)[None, :]


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centres of Lloyd's iteration; an empty cell takes the row that is farthest from its centre."""
    order = np.random.default_rng(seed)
    words = x[order.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = _square_distances(x, words)
        own = d.argmin(axis=1)
        size = np.bincount(own, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, own, x)
        far = np.argsort(-d[np.arange(len(x)), own])
        empty = np.flatnonzero(size == 0)
        words = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], words)
        words[empty] = x[far[:len(empty)]]
    return words


@dataclass(frozen=True)
class Grid:
    left: np.ndarray
    right: np.ndarray
    visits: int = 1

    def distances(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.left.shape[1]
        return _square_distances(u[:, :cut], self.left), _square_distances(u[:, cut:], self.right)

    def walk(self, u: np.ndarray, visits: int) -> np.ndarray:
        """The first ``visits`` cells of the multi-sequence walk of each row. The pair of the i-th and j-th nearest
        codewords comes after i x j pairs at least (counting from 1), so only pairs with i x j <= visits matter."""
        d1, d2 = self.distances(u)
        k2 = d2.shape[1]
        visits = min(visits, d1.shape[1] * k2)
        o1, o2 = np.argsort(d1, axis=1, kind="stable"), np.argsort(d2, axis=1, kind="stable")
        i, j = np.array([(a, b) for a in range(d1.shape[1]) for b in range(min(k2, visits // (a + 1)))],
                        dtype=np.int64).T
        s1, s2 = np.take_along_axis(d1, o1, axis=1), np.take_along_axis(d2, o2, axis=1)
        near = np.argsort(s1[:, i] + s2[:, j], axis=1, kind="stable")[:, :visits]
        return np.take_along_axis(o1, i[near], axis=1) * k2 + np.take_along_axis(o2, j[near], axis=1)


def _places(grid: Grid, ask: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many cells the walk of row ``q`` of ``ask`` visits before the home cell of its partner ``x``."""
    cells = len(grid.left) * len(grid.right)
    d1, d2 = grid.distances(x)
    home = d1.argmin(axis=1) * len(grid.right) + d2.argmin(axis=1)
    e1, e2 = grid.distances(ask)
    out = np.empty(len(q), dtype=np.int64)
    step = max(1, (1 << 22) // cells)
    for at in range(0, len(q), step):
        part = slice(at, at + step)
        sums = (e1[q[part]][:, :, None] + e2[q[part]][:, None, :]).reshape(-1, cells)
        out[part] = (sums < np.take_along_axis(sums, home[part][:, None], axis=1)).sum(axis=1)
    return out


def fit(u: np.ndarray, total: int, least: float, recall: float, queries: int = 1000) -> Grid:
    """Codebooks for ``total`` vectors from the sample ``u``, and the walk length that meets ``recall`` both of the
    pairs of the sample's first rows (each row counting alike) and of partners made at just the least cosine in
    random directions, which are harder to meet than the closer pairs that most are."""
    k = max(2, min(MOST_WORDS, math.ceil(math.sqrt(total / CELL))))
    cut = u.shape[1] // 2
    grid = Grid(codebook(u[:, :cut], k), codebook(u[:, cut:], k))
    ask = u[:queries]
    q, x = np.nonzero(ask @ u.T >= least)
    q, x = q[q != x], x[q != x]
    one = np.random.default_rng(2).permutation(len(q))
    first = one[np.unique(q[one], return_index=True)[1]]        # one random partner a row
    noise = np.random.default_rng(1).normal(size=ask.shape)
    noise -= (noise * ask).sum(axis=1, keepdims=True) * ask
    noise /= np.maximum(np.sqrt((noise * noise).sum(axis=1, keepdims=True)), 1e-12)
    made = least * ask + math.sqrt(1 - least * least) * noise
    visits = 1 + int(np.quantile(_places(grid, ask, np.arange(len(ask)), made), recall))
    if len(first):
        visits = max(visits, 1 + int(np.quantile(_places(grid, ask, q[first], u[x[first]]), recall)))
    return Grid(grid.left, grid.right, min(len(grid.left) * len(grid.right), visits))


def classes(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(vector, node, weight, first)``: the distinct vectors that can link; ``first`` is the smallest id."""
    v = F.col("v")
    good = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")) \
        .where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
               & F.exists(v, lambda x: x != 0))
    return good.groupBy("v").agg(F.count("*").alias("weight"), F.min("id").alias("first")) \
        .withColumn("node", F.monotonically_increasing_id())


def links(reps: DataFrame, size: int, least: float, recall: float, sample: int, kind: str = "f8") -> DataFrame:
    """Verified links of the classes of one vector length: rows ``(u, v, n)``, a forest link if ``v`` is set, else
    ``n`` more vectors linked to ``u``. Vectors travel as numbers of ``kind``, which must hold them exactly."""
    total = reps.count()
    some = reps.orderBy(F.xxhash64("v"), "node").limit(sample).select("v").toPandas()["v"]
    grid = fit(unit([np.asarray(x, np.float64).tobytes() for x in some], size), total, least, recall)
    spark = reps.sparkSession
    shared = spark.sparkContext.broadcast(grid)             # 2 x MOST_WORDS centres at most

    def index(batches):
        g = shared.value
        for pdf in batches:
            data = [np.asarray(x, kind).tobytes() for x in pdf["v"]]
            walk = g.walk(unit(data, size, kind), g.visits).astype(np.int32)
            rows = {"node": pdf["node"], "weight": pdf["weight"], "vec": data, "home": walk[:, 0]}
            member = pd.DataFrame(rows)
            member["cell"], member["member"] = member["home"], True
            member["walk"] = [w.tobytes() for w in walk]
            yield member[["cell", "member", "node", "weight", "vec", "home", "walk"]]
            for t in range(walk.shape[1]):
                visitor = pd.DataFrame(rows)
                visitor["cell"], visitor["member"], visitor["walk"] = walk[:, t], False, None
                yield visitor[["cell", "member", "node", "weight", "vec", "home", "walk"]]

    schema = "cell int, member boolean, node long, weight long, vec binary, home int, walk binary"
    listed = reps.select("node", "weight", "v").mapInPandas(index, schema)
    # members and visitors of a cell, from the walks alone
    sizes = cut_lineage(listed.groupBy("cell").agg(F.sum(F.col("member").cast("long")).alias("members"),
                                                   F.sum((~F.col("member")).cast("long")).alias("visitors")))
    blocks = sizes.where("members > 0").select("cell", F.ceil(F.col("members") / BLOCK).alias("mb"),
                                               F.ceil(F.col("visitors") / BLOCK).alias("vb"))
    dealt = listed.join(blocks, "cell") \
        .withColumn("m", F.when(F.col("member"), F.array(F.pmod(F.xxhash64("node"), "mb")))
                    .otherwise(F.sequence(F.lit(0).cast("long"), F.col("mb") - 1))) \
        .withColumn("q", F.when(F.col("member"), F.sequence(F.lit(0).cast("long"), F.col("vb") - 1))
                    .otherwise(F.array(F.pmod(F.xxhash64("node", F.lit(1)), "vb")))) \
        .withColumn("m", F.explode("m")).withColumn("q", F.explode("q")).drop("mb", "vb")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        is_member = pdf["member"].to_numpy(dtype=bool)
        them, us = pdf[is_member], pdf[~is_member]
        empty = pd.DataFrame({"u": np.zeros(0, np.int64), "v": pd.array([], dtype="Int64"), "n": np.zeros(0, np.int64)})
        if not len(them) or not len(us):
            return empty
        a, b = unit(list(us["vec"]), size, kind), unit(list(them["vec"]), size, kind)
        na, nb = us["node"].to_numpy(), them["node"].to_numpy()
        wa, wb = us["weight"].to_numpy(), them["weight"].to_numpy()
        home = us["home"].to_numpy()
        walks = np.frombuffer(b"".join(them["walk"]), np.int32).reshape(len(them), -1)
        mine, theirs = np.zeros(len(us), np.int64), np.zeros(len(them), np.int64)
        fu, fv = [], []
        for at in range(0, len(us), 256):
            part = slice(at, at + 256)
            hit = (a[part] @ b.T >= least) & (na[part][:, None] != nb[None, :])
            if not hit.any():
                continue
            mine[part] = hit @ wb
            i, j = np.nonzero(hit)
            seen = (walks[j] == home[at + i][:, None]).any(axis=1)         # they find us on their own walk
            np.add.at(theirs, j[~seen], wa[at + i[~seen]])
            x, y = forest(na[at + i], nb[j])
            fu.append(x)
            fv.append(y)
        u, v = forest(np.concatenate(fu), np.concatenate(fv)) if fu else (na[:0], na[:0])
        node, n = np.concatenate([na, nb]), np.concatenate([mine, theirs])
        some = n > 0
        return pd.concat([pd.DataFrame({"u": u, "v": pd.array(v, dtype="Int64"), "n": np.zeros(len(u), np.int64)}),
                          pd.DataFrame({"u": node[some], "v": pd.array([None] * int(some.sum()), dtype="Int64"),
                                        "n": n[some]})])

    return dealt.groupBy("cell", "m", "q").applyInPandas(verify, "u long, v long, n long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9,
                    recall: float = 0.98, sample: int = 20_000) -> DataFrame:
    """One row per vector: its id, the number of other vectors linked, its component (smallest id) and whether it is
    the one to keep."""
    reps = cut_lineage(classes(vectors, key, vector))
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"       # floats travel as they came
    found = None
    for row in reps.select(F.size("v").alias("size")).distinct().orderBy("size").collect():
        same = reps.where(F.size("v") == row["size"])
        part = links(same, row["size"], least, recall, sample, "f4" if single else "f8")
        found = part if found is None else found.unionByName(part)
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    if found is None:
        named = rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    else:
        found = cut_lineage(found)
        counts = found.where("v is null").groupBy("u").agg(F.sum("n").alias("n"))
        groups = components(found.where("v is not null").select("u", "v"))
        with_group = reps.join(groups, reps["node"] == groups["node"], "left") \
            .select(reps["node"], "v", "weight", "first", F.coalesce("component", reps["node"]).alias("component"))
        smallest = with_group.groupBy("component").agg(F.min("first").alias("component_id"))
        facts = with_group.join(smallest, "component") \
            .join(counts, F.col("node") == counts["u"], "left") \
            .select("v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id",
                    F.lit(True).alias("linked"))
        named = rows.join(facts, "v", "left").select(
            "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return named.select(F.col("id").alias(key), "n_links", "component_id",
                        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
