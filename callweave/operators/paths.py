"""Simple paths and cycles, by one join for each step. There may be exponentially many, so a depth is always given."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import keep
from .traversal import bfs, one


def _steps(edges: DataFrame, start: str, max_nodes: int, end: str | None = None) -> list[DataFrame]:
    """Tables of (path, last), of one node, two, and so on, over edges that are kept; paths that have come to `end` go no further."""
    if max_nodes < 1:
        return []
    level = one(edges, start).select(F.array("id").alias("path"), F.col("id").alias("last"))
    levels = [level]
    for _ in range(2, max_nodes + 1):
        going = level if end is None else level.filter(F.col("last") != end)
        step = going.join(edges, going["last"] == edges["src"]).filter(~F.array_contains("path", F.col("dst")))
        level = keep(step.select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("last")))
        if level.isEmpty():
            break
        levels.append(level)
    return levels


def all_paths(edges: DataFrame, start: str, end: str, max_depth: int) -> DataFrame:
    """(path): simple paths of fewer than max_depth edges. Edges that repeat make paths that repeat.

    Half paths from both ends meet in the middle node: that from the start has as many edges as that to the
    end, or one more, and they share no other node. So each path is found once, and what is walked grows
    with half of the depth only.
    """
    if max_depth < 1:
        return one(edges, start).select(F.array("id").alias("path")).limit(0)
    edges = keep(edges.select("src", "dst"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    there = reduce(DataFrame.unionByName, _steps(edges, start, max_depth // 2 + 1, end))
    here = reduce(DataFrame.unionByName, _steps(back, end, (max_depth - 1) // 2 + 1, start))
    far, near = there.withColumnRenamed("path", "far"), here.select(F.col("path").alias("near"), F.col("last").alias("meet"))
    halves = far.join(near, (F.col("last") == F.col("meet")) & (F.size("far") - F.size("near")).between(0, 1))
    apart = halves.filter(F.size(F.array_intersect("far", "near")) == 1)
    return apart.select(F.concat("far", F.reverse(F.slice("near", 1, F.size("near") - 1))).alias("path"))


def _going_on(edges: DataFrame, rounds: int) -> DataFrame:
    """Edges, kept, without those that lead nowhere within so many steps: in each round those go whose end calls nothing, until none does."""
    left = keep(edges.select("src", "dst"))
    n = left.count()
    for _ in range(rounds):
        calling = left.select(F.col("src").alias("dst")).distinct()
        fewer = keep(left.join(calling, "dst", "left_semi").select("src", "dst"))
        before, n, left = n, fewer.count(), fewer
        if n == before:
            break
    return left


def cycles(edges: DataFrame, start: str, max_depth: int) -> DataFrame:
    """(cycle): for each simple path of at most max_depth nodes from start, each edge back into it, from where it enters to there again.

    Cycles that don't pass through start count; one comes again for every path that leads to it and
    for every repeated edge. A call of itself is [a, a]. What leads to no cycle isn't walked.
    """
    if max_depth < 1:
        return one(edges, start).select(F.array("id").alias("cycle")).limit(0)
    edges = _going_on(edges, max_depth)
    back = reduce(DataFrame.unionByName, _steps(edges, start, max_depth)).join(edges, F.col("last") == F.col("src")).filter(F.array_contains("path", F.col("dst")))
    at = F.array_position("path", F.col("dst")).cast("int")
    return back.select(F.array_append(F.slice("path", at, F.size("path")), F.col("dst")).alias("cycle"))


def path_analysis(sites: DataFrame, start: str) -> DataFrame:
    """One row over the shortest paths from start, its own of no edge included: total_paths, max_depth, avg_depth."""
    return bfs(sites.select("src", "dst"), one(sites, start)).agg(
        F.count("*").alias("total_paths"), F.max("depth").cast("long").alias("max_depth"), F.avg("depth").alias("avg_depth"))
