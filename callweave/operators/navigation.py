"""Steps between the nodes of an extracted graph: siblings with wrap-around, middle child, active parent.

Children are numbered over all parents at once, by ranges that are sorted side by side, so that a parent
with a third of all edges is no task of its own; for siblings only those of such parents are, all others
move to their parent. Children that repeat stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import frequent, numbered


def _ranked(edges: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Edges with their number `at`, and for each key the range of its numbers: low, high."""
    ranked = numbered(edges.select("src", "dst", "ord"), [key, *order], "at")
    return ranked, ranked.groupBy(key).agg(F.min("at").alias("low"), F.max("at").alias("high"))


#: Children of one parent from which on they are no task of their own.
HUB = 1_000_000


def siblings(edges: DataFrame) -> DataFrame:
    """edges(src, dst, ord) -> (parent, idx, ord, next, previous): the first follows the last.

    Children move once, to their parent; only those of parents that have very many are numbered over ranges.
    """
    edges = edges.select("src", "dst", "ord")
    hubs = frequent(edges, "src", HUB)
    if not hubs:
        return _families(edges)
    of_hub = F.coalesce(F.col("src").isin(hubs), F.lit(False))
    return _families(edges.filter(~of_hub)).unionByName(_long_families(edges.filter(of_hub)))


def _families(edges: DataFrame) -> DataFrame:
    """Siblings where a family fits a task."""
    turn = Window.partitionBy("src").orderBy("ord", "dst")
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return edges.select(
        F.col("src").alias("parent"), F.col("dst").alias("idx"), "ord",
        F.coalesce(F.lead("dst").over(turn), F.first("dst").over(whole)).alias("next"),
        F.coalesce(F.lag("dst").over(turn), F.last("dst").over(whole)).alias("previous"))


def _long_families(edges: DataFrame) -> DataFrame:
    """Siblings of few parents with very many children.

    Neighbours are looked up within ranges; only those on the other side of a border are joined.
    """
    ranked = numbered(edges, ["src", "ord", "dst"], "at", "part")
    end = F.struct("at", "dst")
    ends = ranked.groupBy("src").agg(F.min(end).alias("low"), F.max(end).alias("high"))
    # One row for each range, so that the windows over all of them are small; `after` is the child before a range, `ahead` that behind it.
    borders = ranked.groupBy("part").agg(F.min(end).alias("first"), F.max(end).alias("last"))
    by_part = Window.orderBy("part")
    borders = borders.select("part", F.lag("last.dst").over(by_part).alias("after"), F.lead("first.dst").over(by_part).alias("ahead"))
    turn = Window.partitionBy("part").orderBy("at")
    near = ranked.select("*", F.lead("dst").over(turn).alias("next"), F.lag("dst").over(turn).alias("previous"))
    near = near.join(F.broadcast(borders), "part").join(F.broadcast(ends), "src")
    return near.select(
        F.col("src").alias("parent"), F.col("dst").alias("idx"), "ord",
        F.when(F.col("at") == F.col("high.at"), F.col("low.dst")).otherwise(F.coalesce("next", "ahead")).alias("next"),
        F.when(F.col("at") == F.col("low.at"), F.col("high.dst")).otherwise(F.coalesce("previous", "after")).alias("previous"))


def middle_children(edges: DataFrame) -> DataFrame:
    """(parent, child): of n children number (n - 1) / 2, from 0."""
    ranked, ends = _ranked(edges, "src", ["ord", "dst"])
    middle = ends.select((F.col("low") + F.floor((F.col("high") - F.col("low")) / 2)).alias("at"))
    return ranked.join(middle, "at").select(F.col("src").alias("parent"), F.col("dst").alias("child"))


def active_parents(edges: DataFrame, cursor: int) -> DataFrame:
    """(idx, parent): of each node's parents the one at the cursor, which goes round."""
    ranked, ends = _ranked(edges, "dst", ["src", "ord"])
    active = ends.select((F.col("low") + F.pmod(F.lit(cursor), F.col("high") - F.col("low") + 1)).alias("at"))
    return ranked.join(active, "at").select(F.col("dst").alias("idx"), F.col("src").alias("parent"))
