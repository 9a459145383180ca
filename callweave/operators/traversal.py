"""Breadth-first walks over edges. A level is a join; what a level finds is written, and a table of levels is never joined with itself.

Spark broadcasts a narrow level by the size of its files, and the edges stay where they are. With the
first wide one they are put into buckets by where they begin, once, so that after it only levels move.
Deep graphs take as many jobs as they have levels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import bucketed, keep, numbered, partitions

#: After so many levels what was seen is written as one table again.
LEVELS = 16
#: Rows from which on a level is wide.
WIDE = 200_000
#: Starts of walks that share a row: the bits of a long.
STARTS = 64
#: An id that begins more than one in so many edges for each bucket is spread over buckets.
SHARE = 4


class Roads:
    """Edges(src, dst), with more columns or none, that levels are joined with again and again; they are kept.

    once: it makes no difference how often an edge is there, so that buckets needn't hold the repeats of a hub's edges.
    """

    def __init__(self, edges: DataFrame, once: bool = False):
        self.edges, self.once, self.split = edges, once, None
        self.told = ["dst", *[c for c in edges.columns if c not in ("src", "dst")]]

    def back(self) -> Roads:
        """The same edges the other way."""
        return Roads(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *self.told[1:]), self.once)

    def _split(self) -> tuple[DataFrame, DataFrame]:
        """Edges in buckets by src and salt, and (id, salts) of those sources that have more than one salt, at most SHARE for each bucket."""
        n = partitions(self.edges.sparkSession)
        most = max(1, self.edges.count() // (n * SHARE))
        out = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") > most)
        hubs = keep(out.select("id", F.ceil(F.col("n") / most).cast("int").alias("salts")))
        salt = F.pmod(F.hash("dst"), F.coalesce("salts", F.lit(1)))
        placed = self.edges.join(F.broadcast(hubs), F.col("src") == F.col("id"), "left").select("src", salt.alias("salt"), *self.told, F.col("salts").isNotNull().alias("hub"))
        salted = placed.drop("hub")
        if self.once and not hubs.isEmpty():
            # All repeats of an edge have one salt: as many as make a hub of it would be one bucket.
            salted = placed.filter(~F.col("hub")).drop("hub").unionByName(placed.filter("hub").drop("hub").distinct())
        return bucketed(salted, ["src", "salt"]), hubs

    def ahead(self, level: DataFrame, n: int) -> DataFrame:
        """level, of n rows and with a column id, -> its rows once for each edge that begins there, with dst and what else is told of the edge."""
        if n < WIDE:
            return level.join(self.edges, level["id"] == self.edges["src"]).select(*level.columns, *self.told)
        self.split = self.split or self._split()
        edges, hubs = self.split
        salts = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
        spread = level.join(F.broadcast(hubs), "id", "left").select(*level.columns, salts)
        return spread.join(edges, (spread["id"] == edges["src"]) & (spread["salt"] == edges["salt"])).select(*level.columns, *self.told)


def _levels(seeds: DataFrame, ahead: Callable[[DataFrame, int], DataFrame], max_depth: int | None) -> DataFrame:
    """seeds and, with the depth at which they are first found, all rows like them that `ahead` finds from level to level."""
    keys = seeds.columns
    level = seen = keep(seeds.distinct().withColumn("depth", F.lit(0)))
    depth, n = 0, level.count()
    while n and (max_depth is None or depth < max_depth):
        depth += 1
        found = ahead(level, n).select(*keys).distinct()
        level = keep(found.join(seen, keys, "left_anti").withColumn("depth", F.lit(depth)))
        n = level.count()
        if n:
            seen = seen.unionByName(level)
        if depth % LEVELS == 0:
            seen = keep(seen)
    return seen


def _roads(edges: DataFrame | Roads) -> Roads:
    """Edges kept as they are: a level's finds are distinct whether its edges are or not, and making all edges distinct would move them all."""
    return edges if isinstance(edges, Roads) else Roads(keep(edges.select("src", "dst")), once=True)


def bfs(edges: DataFrame | Roads, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """edges(src, dst), repeats or none, seeds(id) -> (id, depth): what can be reached and in how many steps; seeds count whether or not they have edges."""
    roads = _roads(edges)
    return _levels(seeds.select("id"), lambda level, n: roads.ahead(level, n).select(F.col("dst").alias("id")), max_depth)


def closures(edges: DataFrame | Roads, starts: DataFrame) -> DataFrame:
    """edges(src, dst), starts(id) -> (start, id, depth): what each start reaches, itself included, by one walk for all of them.

    Starts are the bits of a long, STARTS to a block: a row of a level is an id with all starts of a block that
    come to it there first, so that what many of them reach moves once for them.
    """
    roads = _roads(edges)
    n_th = numbered(starts.select(F.col("id").alias("start")).distinct(), ["start"], "k")
    places = keep(n_th.select("start", F.floor(F.col("k") / STARTS).alias("block"), F.expr(f"shiftleft(1L, int(k % {STARTS}))").alias("bits")))
    level = seen = keep(places.select("block", F.col("start").alias("id"), "bits", F.lit(0).alias("depth")))
    depth, n = 0, level.count()
    while n:
        depth += 1
        found = roads.ahead(level.select("block", "id", "bits"), n).groupBy("block", F.col("dst").alias("id")).agg(F.bit_or("bits").alias("bits"))
        known = seen.groupBy("block", "id").agg(F.bit_or("bits").alias("known"))
        new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long"))))
        level = keep(found.join(known, ["block", "id"], "left").select("block", "id", new.alias("bits"), F.lit(depth).alias("depth")).filter("bits <> 0"))
        n = level.count()
        if n:
            seen = seen.unionByName(level)
        if depth % LEVELS == 0:
            seen = keep(seen)
    of = places.select("start", F.col("block").alias("_block"), F.col("bits").alias("_bit"))
    return seen.join(of, (F.col("block") == F.col("_block")) & (F.col("bits").bitwiseAND(F.col("_bit")) != 0)).select("start", "id", "depth")


def both_ways(edges: DataFrame | Roads, id_: str) -> DataFrame:
    """(id, on, depth): what an id reaches (on is true) and what can reach it (false), itself included in both, by one walk over edges that are kept once.

    Each direction has its own width: edges aren't put into buckets for a direction that stays narrow.
    """
    forth = _roads(edges)
    back = forth.back()

    def ahead(level: DataFrame, n: int) -> DataFrame:
        of_way = {on: level.filter(F.col("on") == on) for on in (True, False)}
        ways = [roads.ahead(of_way[on], n if n < WIDE else of_way[on].count()).select(F.col("dst").alias("id"), "on") for roads, on in ((forth, True), (back, False))]
        return ways[0].unionByName(ways[1])

    return _levels(one(forth.edges, id_).select("id", F.explode(F.array(F.lit(True), F.lit(False))).alias("on")), ahead, None)


def one(edges: DataFrame, id_: str) -> DataFrame:
    return edges.sparkSession.range(1).select(F.lit(id_).alias("id"))


def reachable(edges: DataFrame, start: str) -> DataFrame:
    """Ids that start reaches, itself included even where nobody knows it. Reversed edges give who can reach it."""
    return bfs(edges, one(edges, start)).select("id")


def at_depth(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """Ids at exactly this distance."""
    return bfs(edges, one(edges, start), depth).filter(F.col("depth") == depth).select("id")


def call_depth(edges: DataFrame, start: str) -> DataFrame:
    """(id, depth): the smallest number of calls from start."""
    return bfs(edges, one(edges, start))


def bfs_tree(sites: DataFrame | Roads, start: str, max_depth: int | None = None, until: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """sites(src, dst, seq) -> (id, depth, path, ord): one shortest path to each id.

    Of shortest paths it is the one a queue would find: the first by the sequence numbers of its calls,
    from the start on. `until` ends the walk with the level that holds this id. Of ids that are found those
    that aren't `known` (id) are left out.
    """
    roads = sites if isinstance(sites, Roads) else Roads(keep(sites.select("src", "dst", "seq")))
    level = seen = keep(one(roads.edges, start).select("id", F.lit(0).alias("depth"), F.array("id").alias("path"), F.array().cast("array<bigint>").alias("ord")))
    depth, n = 0, 1
    while (max_depth is None or depth < max_depth) and (until is None or level.filter(F.col("id") == until).isEmpty()):
        depth += 1
        found = roads.ahead(level, n).select("dst", F.struct(F.array_append("ord", F.col("seq")).alias("ord"), "path").alias("by"))
        best = found.groupBy(F.col("dst").alias("id")).agg(F.min("by").alias("by")).join(seen, "id", "left_anti")
        best = best if known is None else best.join(known, "id", "left_semi")
        level = keep(best.select("id", F.lit(depth).alias("depth"), F.array_append("by.path", F.col("id")).alias("path"), F.col("by.ord").alias("ord")))
        n = level.count()
        if not n:
            break
        seen = seen.unionByName(level)
        if depth % LEVELS == 0:
            seen = keep(seen)
    return seen


def shortest_path(sites: DataFrame, start: str, end: str) -> DataFrame:
    """(path): one row, or none if there is no path; the path from a function to itself is that function."""
    return bfs_tree(sites, start, until=end).filter(F.col("id") == end).select("path")


def shortest_paths(sites: DataFrame, start: str) -> DataFrame:
    """(id, path) of everything reachable, the start included."""
    return bfs_tree(sites, start).select("id", "path")


def dag(sites: DataFrame, known: DataFrame, root: str, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The part of a graph around a root: nodes(idx, id, depth) in order of discovery, edges(src, dst, ord) by idx.

    Calls from and to ids outside of `known` (id) are left out. Nodes at max_depth stay but their calls
    don't, even those to nodes that are in. Call sites that repeat a pair are edges each. An unknown
    root raises.
    """
    if known.filter(F.col("id") == root).isEmpty():
        raise ValueError(f"no such function: {root}")
    roads = Roads(keep(sites.select("src", "dst", "seq")))
    nodes = keep(numbered(bfs_tree(roads, root, max_depth, known=known.select("id")), ["depth", "ord"]).select("idx", "id", "depth"))
    open_ = nodes if max_depth is None else nodes.filter(F.col("depth") < max_depth)
    calls = roads.ahead(open_.select("id", F.col("idx").alias("src_idx")), open_.count())
    ends = calls.join(nodes.select(F.col("id").alias("dst"), F.col("idx").alias("dst_idx")), "dst")
    edges = ends.select(F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst"), F.col("seq").alias("ord"))
    return nodes, edges


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes(idx) without a predecessor."""
    return nodes.join(edges.select(F.col("dst").alias("idx")), "idx", "left_anti")


def check_edges(nodes: DataFrame, edges: DataFrame) -> None:
    """Raises if an edge has an end that is no node."""
    ends = edges.select(F.col("src").alias("idx")).unionByName(edges.select(F.col("dst").alias("idx")))
    bad = ends.join(nodes, "idx", "left_anti").limit(1).collect()
    if bad:
        raise ValueError(f"no such node: {bad[0].idx}")
