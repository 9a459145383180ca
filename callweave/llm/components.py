"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


class Forest:
    """Union-find over 0..n-1 inside a task; the smallest number of a tree is its root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        """The root of every number."""
        while (nxt := self.up[self.up]).tolist() != self.up.tolist():
            self.up = nxt
        return self.up


def is_done(star: DataFrame) -> bool:
    """Whether every node points to one other at most, and none that points is pointed to."""
    ends = star.select(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(star.select(F.col("b").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 or out = 1 and into = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs -> (id, component): the smallest id of its component, for every id that has an edge to another.

    Each round makes all neighbours of a node point to the smallest of them, first the larger ones,
    then the smaller ones, until each component is a star around its smallest
    id. Only minima are gathered, so that a hub needs no more room than other nodes.
    """
    star = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while not is_done(star):
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.withColumnRenamed("m", "b")).filter("a <> b").distinct()
        star = cut(small)
    return star.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(star.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
