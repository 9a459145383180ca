"""Paths of a layout painted on a grid of characters, and a view that is laid out again only when it has changed.

A screen of some width and height shows a part of the world. Each stroke has a place in the painter's
order, and of what is painted on a cell the last stays: a maximum that is aggregated before it is
shuffled. Lines are cut to the screen before their cells are made, so that a path of any length makes
no more cells than the screen has.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import CallGraph
from ..storage import keep
from . import layout, traversal

# Glyphs of lines, corners and heads of arrows.
ACROSS, DOWN = "─", "│"
CORNERS = {"TopRight": "┐", "BottomRight": "┘", "BottomLeft": "└", "TopLeft": "┌"}
RIGHT, LEFT, LOWER, UPPER = "▶", "◀", "▼", "▲"
#: The painter's order: lines of paths, those that end in a trunk, heads of both, trunks, and paths that go back.
ORDER = {"edge": 0, "merged": 1, "trunk": 4, "cross": 5}
HEADS, MERGED_HEADS = 2, 3
#: After all segments of a path.
LAST = (1 << 31) - 1


def on_screen(p: Column, offset: tuple[float, float], scale: float) -> tuple[Column, Column]:
    """Column and row of a point; what is left and above of the screen is below 0."""
    s = layout.clamped_scale(scale)
    return ((p["x"] - offset[0]) * s).cast("int"), ((p["y"] - offset[1]) * s).cast("int")


def turn(phase: Column | int, at: Column, step: int = 0) -> Column:
    """A stroke's place in the painter's order: by paths, then along them."""
    phase = phase if isinstance(phase, Column) else F.lit(phase)
    return F.struct(phase.cast("int").alias("phase"), "parent_id", "child_id", at.cast("int").alias("at"), F.lit(step).alias("step"))


def heads(paths: DataFrame, reverse: bool) -> DataFrame:
    """Paths with a head (head: its phase): one for each node that paths lead to, the first path's, and each trunk's; reversed, one for each node that paths leave, and none of trunks."""
    key = "parent_id" if reverse else "child_id"

    def first(of: str, phase: int) -> DataFrame:
        some = paths.filter(F.col("class") == of)
        one = some.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*paths.columns), F.struct("parent_id", "child_id")).alias("p"))
        return one.select("_key", "p.*", F.lit(phase).alias("head"))

    found = first("edge", HEADS)
    if reverse:
        found = found.unionByName(first("merged", MERGED_HEADS).join(found.select("_key"), "_key", "left_anti"))
    else:
        found = found.unionByName(paths.filter("class = 'trunk'").select(F.col("child_id").alias("_key"), "*", F.lit(ORDER["trunk"]).alias("head")))
    return found.drop("_key")


def painted(paths: DataFrame, width: int, height: int, offset: tuple[float, float] = (0.0, 0.0), scale: float = 1.0, reverse: bool = False) -> DataFrame:
    """paths(class, parent_id, child_id, segments) -> (x, y, glyph) of the cells of a screen that something is painted on.

    Lines spare the ends where a corner is. Heads stand one cell before the node they lead to, or with `reverse`
    one after the node that a path leaves, and look back at it. Paths that repeat are painted once more.
    """
    in_order = paths.withColumn("phase", F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair])[F.col("class")])
    pieces = in_order.select("phase", "parent_id", "child_id", "segments", F.posexplode("segments").alias("at", "s"))
    corner = lambda i: F.coalesce(F.get("segments", i)["type"].isin(*CORNERS), F.lit(False)).cast("int")
    x0, y0 = on_screen(F.col("s.from"), offset, scale)
    x1, y1 = on_screen(F.col("s.to"), offset, scale)
    s = pieces.select(turn(F.col("phase"), F.col("at")).alias("z"), F.col("s.type").alias("type"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), corner(F.col("at") - 1).alias("before"), corner(F.col("at") + 1).alias("after"))

    def line(kind: str, a: str, b: str, size: int) -> tuple[DataFrame, Column]:
        start = F.greatest(F.least(a, b) + F.col("before"), F.lit(0))
        end = F.least(F.greatest(a, b) - F.col("after"), F.lit(size - 1))
        return s.filter((F.col("type") == kind) & (start <= end)), F.explode(F.sequence(start, end))

    rows, along = line("Horizontal", "x0", "x1", width)
    across = rows.select(along.alias("x"), F.col("y0").alias("y"), "z", F.lit(ACROSS).alias("glyph"))
    rows, along = line("Vertical", "y0", "y1", height)
    down = rows.select(F.col("x0").alias("x"), along.alias("y"), "z", F.lit(DOWN).alias("glyph"))
    named = F.create_map(*[F.lit(x) for pair in CORNERS.items() for x in pair])[F.col("type")]
    corners = s.filter(F.col("type").isin(*CORNERS)).select(F.col("x0").alias("x"), F.col("y0").alias("y"), "z", named.alias("glyph"))

    # A head sits on the last straight segment, reversed on the first.
    straight = F.filter("segments", lambda x: ~x["type"].isin(*CORNERS))
    seg = F.get(straight, F.lit(0) if reverse else F.size(straight) - 1)
    tips = heads(paths, reverse).withColumn("seg", seg).filter("seg is not null")
    tx, ty = on_screen(F.col("seg.from") if reverse else F.col("seg.to"), offset, scale)
    level, ahead = F.col("seg.type") == "Horizontal", F.when(F.col("seg.type") == "Horizontal", F.col("seg.to.x") >= F.col("seg.from.x")).otherwise(F.col("seg.to.y") >= F.col("seg.from.y"))
    step = F.when(ahead, 1 if reverse else -1).otherwise(-1 if reverse else 1)
    to, back = (LEFT, RIGHT) if reverse else (RIGHT, LEFT)
    below, above = (UPPER, LOWER) if reverse else (LOWER, UPPER)
    glyph = F.when(level, F.when(ahead, to).otherwise(back)).otherwise(F.when(ahead, below).otherwise(above))
    arrows = tips.select((tx + F.when(level, step).otherwise(0)).alias("x"), (ty + F.when(level, 0).otherwise(step)).alias("y"), turn(F.col("head"), F.lit(LAST), 1).alias("z"), glyph.alias("glyph"))

    every = across.unionByName(down).unionByName(corners).unionByName(arrows)
    seen = every.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    return seen.groupBy("x", "y").agg(F.max_by("glyph", "z").alias("glyph"))


#: Sizes and distances of a view's nodes, steps from its root, and rows that its frame takes.
VIEW = layout.LayoutConfig(node_width=24.0, node_height=3.0, node_separation=5.0, level_separation=36.0, subtree_separation=1.0)
DEPTH, FRAME = 5, 2.0


@dataclass
class GraphView:
    """What is shown around a function: those that call it, or with outgoing those that it calls.

    A view knows a stamp of what it has laid out. `update` takes the part of the graph that is shown and does
    nothing more if its stamp is the same: neither what is added elsewhere nor the order of rows matters.
    """

    root: str
    outgoing: bool = False
    max_depth: int | None = DEPTH
    config: layout.LayoutConfig = VIEW
    offset: tuple[float, float] = (0.0, 0.0)
    scale: float = 1.0
    #: Layouts so far.
    version: int = 0
    nodes: DataFrame | None = field(default=None, repr=False)
    positions: DataFrame | None = field(default=None, repr=False)
    paths: DataFrame | None = field(default=None, repr=False)
    stamp: tuple | None = None

    def update(self, g: CallGraph, size: tuple[float, float]) -> bool:
        """Whether the view was laid out again. The first time its root comes to the middle of the screen's height."""
        nodes, edges = traversal.dag(g.sites if self.outgoing else g.reversed_sites, g.functions.select("id"), self.root, self.max_depth)
        edges = edges.groupBy("src", "dst").agg(F.min("ord").alias("ord"))
        mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns)), F.sum(F.xxhash64(F.lit("sum"), *df.columns).cast("decimal(38,0)"))).first())
        # The order of calls counts, not their numbers: ids are in order of discovery.
        stamp = (self.root, self.outgoing, self.max_depth, mark(nodes.select("idx", "id", "depth")), mark(edges.select("src", "dst")))
        if stamp == self.stamp:
            return False
        positions, paths = layout.layout(nodes, edges, self.config)
        first = self.positions is None
        self.nodes, self.positions, self.paths, self.stamp = nodes, keep(positions), keep(paths), stamp
        self.version += 1
        if first:
            self.offset = (0.0, self.place_of_root()[1] - (size[1] - FRAME) / 2)
        return True

    def place_of_root(self) -> tuple[float, float]:
        at = self.positions.filter("idx = 0").first()
        return float(at.x), float(at.y)

    def turn_round(self) -> None:
        """Shows the other direction from the next update on."""
        self.outgoing = not self.outgoing

    def recenter(self, size: tuple[float, float]) -> None:
        x, y = self.place_of_root()
        self.offset = (x - size[0] / 2, y - size[1] / 2)

    def painted(self, width: int, height: int) -> DataFrame:
        """The cells of a screen; where callers are shown, heads look back at whom they call."""
        return painted(self.paths, width, height, self.offset, self.scale, reverse=not self.outgoing)
