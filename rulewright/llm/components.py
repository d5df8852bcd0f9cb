"""Connected components of a distributed edge list.

Rounds of the published large-star / small-star scheme, each a plain aggregate
and join: every node is re-linked to the smallest node around it until the edges
form stars.  Minima are pre-aggregated before the shuffle and stored, so that the join that
hands them out has plain exchanges on both sides, which adaptive execution can
split: a hub is no hot spot.
Each round ends in a written table; the driver sees two numbers per round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: The scheme ends after O(log(n)^2) rounds; this only guards against a loop without end.
MOST_ROUNDS = 60


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on (u, v), u > v; gives (u, v), u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "minima")
    large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    large = stored(large, "large")
    own = stored(large.groupBy("u").agg(F.min("v").alias("m")), "own")
    small = large.join(own, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(own.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a long, b long).

    ``component`` is the smallest node that can be reached.  Loops, repeated
    edges and nulls at either end are ignored.
    """
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    seen = None
    for _ in range(MOST_ROUNDS):
        clean = stored(clean if seen is None else _stars(clean), "stars")
        now = clean.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return clean.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(clean.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


class UnionFind:
    """Union-find over 0..n-1 inside one task; the root is the smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    def union(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        parent = self.parent
        while True:
            up = parent[parent]
            if (up == parent).all():
                return parent
            self.parent = parent = up


def link_matrix_forest(uf: UnionFind, rows: np.ndarray, cols: np.ndarray) -> None:
    """Join many pairs at once: vectorised hooking of roots to smaller roots."""
    while len(rows):
        roots = uf.roots()
        a, b = roots[rows], roots[cols]
        apart = a != b
        if not apart.any():
            return
        rows, cols, a, b = rows[apart], cols[apart], a[apart], b[apart]
        np.minimum.at(uf.parent, np.maximum(a, b), np.minimum(a, b))
