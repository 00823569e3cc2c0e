"""Connected components of a link table by alternating large and small stars.

Each round regroups the links around their smallest neighbour, first those to
larger nodes, then those to smaller ones, until every node hangs on the
smallest node of its component. Rounds are written to the shared checkpoint
folder; smallest neighbours are found with partial aggregation, so a node with
a third of all links leaves each task as one row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.session import cut_lineage


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that connect what the links ``u``-``v`` connect: a batch of links
    leaves a task as fewer rows than it has nodes."""
    if not len(u):
        return u, v
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            break
        root = new
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def _mark(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node that has a link; ``component`` is the smallest node reachable.

    ``links`` has columns ``u`` and ``v`` (long); loops, repeats and either direction are allowed."""
    links = cut_lineage(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .distinct())
    mark = _mark(links)
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = links.withColumnRenamed("u", "w").join(smallest, F.col("v") == smallest["u"]) \
            .select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut_lineage(large)
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(smallest, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .union(smallest.select("u", F.col("m").alias("v"))) \
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        links = cut_lineage(small)
        now = _mark(links)
        if now == mark:
            roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        mark = now
