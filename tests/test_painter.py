import random

import pytest
from pyspark.sql import functions as F

from callweave.graph import CallGraph
from callweave.operators import layout, painter
from callweave.schema import CALLS, FUNCTIONS

PATHS = "class string, parent_id long, child_id long, segments array<struct<from:struct<x:float,y:float>,to:struct<x:float,y:float>,type:string>>"


def seg(kind, x0, y0, x1=None, y1=None):
    return ((float(x0), float(y0)), (float(x0 if x1 is None else x1), float(y0 if y1 is None else y1)), kind)


def drawn(spark, paths, width, height, **options):
    rows = painter.painted(spark.createDataFrame(paths, PATHS), width, height, **options).collect()
    grid = [[" "] * width for _ in range(height)]
    for r in rows:
        grid[r.y][r.x] = r.glyph
    return ["".join(row).rstrip() for row in grid]


BENT = [seg("Horizontal", 0, 0, 4, 0), seg("TopRight", 4, 0), seg("Vertical", 4, 0, 4, 3), seg("BottomLeft", 4, 3), seg("Horizontal", 4, 3, 9, 3)]


def test_lines_spare_corners_and_heads_stand_before_nodes(spark):
    assert drawn(spark, [("edge", 0, 1, BENT)], 12, 5) == ["────┐", "    │", "    │", "    └───▶─", ""]
    assert drawn(spark, [("edge", 0, 1, BENT)], 12, 5, reverse=True) == ["─◀──┐", "    │", "    │", "    └─────", ""]


def test_paths_are_cut_to_the_screen(spark):
    assert drawn(spark, [("edge", 0, 1, BENT)], 3, 2, offset=(3.0, 0.0)) == ["─┐", " │"]
    assert drawn(spark, [("edge", 0, 1, [seg("Horizontal", -1e6, 1, 1e6, 1)])], 4, 2) == ["", "────"]
    assert drawn(spark, [("edge", 0, 1, BENT)], 30, 8, scale=2.0)[0] == "────────┐"


def test_one_head_for_a_node_and_trunks_carry_it(spark):
    flat = lambda y: [seg("Horizontal", 0, y, 6, y)]
    two = [("edge", 0, 9, flat(0)), ("edge", 1, 9, flat(2))]
    assert drawn(spark, two, 8, 3) == ["─────▶─", "", "───────"]
    merged = [("merged", 0, 9, flat(0)), ("merged", 1, 9, flat(2)), ("trunk", 9, 9, [seg("Horizontal", 6, 1, 9, 1)])]
    assert drawn(spark, merged, 10, 3) == ["───────", "      ──▶─", "───────"]
    assert drawn(spark, merged, 10, 3, reverse=True) == ["─◀─────", "      ────", "─◀─────"]
    assert drawn(spark, [("cross", 3, 0, flat(0))], 8, 1) == ["───────"]


def test_heads_up_and_down(spark):
    assert drawn(spark, [("edge", 0, 1, [seg("Vertical", 0, 0, 0, 3)]), ("edge", 2, 3, [seg("Vertical", 2, 3, 2, 0)])], 3, 4) == ["│ │", "│ ▲", "▼ │", "│ │"]
    assert drawn(spark, [("edge", 0, 1, [seg("Vertical", 0, 0, 0, 3)])], 1, 4, reverse=True) == ["│", "▲", "│", "│"]


def test_the_last_stroke_stays(spark):
    across, down = [seg("Horizontal", 0, 1, 4, 1)], [seg("Vertical", 2, 0, 2, 2)]
    assert drawn(spark, [("merged", 0, 1, across), ("merged", 2, 3, down)], 5, 3) == ["  │", "──│──", "  │"]
    assert drawn(spark, [("merged", 2, 3, across), ("merged", 0, 1, down)], 5, 3) == ["  │", "─────", "  │"]


def plain(paths, width, height, offset, scale, reverse):
    """Strokes one after the other on a grid."""
    grid = {}
    s = min(10.0, max(0.1, scale))
    at = lambda p: (int((p[0] - offset[0]) * s), int((p[1] - offset[1]) * s))

    def put(x, y, glyph):
        if 0 <= x < width and 0 <= y < height:
            grid[(x, y)] = glyph

    def lines(segments):
        for i, (a, b, kind) in enumerate(segments):
            (x0, y0), (x1, y1) = at(a), at(b)
            before = i > 0 and segments[i - 1][2] in painter.CORNERS
            after = i + 1 < len(segments) and segments[i + 1][2] in painter.CORNERS
            if kind == "Horizontal":
                for x in range(min(x0, x1) + before, max(x0, x1) - after + 1):
                    put(x, y0, "─")
            elif kind == "Vertical":
                for y in range(min(y0, y1) + before, max(y0, y1) - after + 1):
                    put(x0, y, "│")
            else:
                put(x0, y0, painter.CORNERS[kind])

    def head(segments):
        rest = [x for x in segments if x[2] not in painter.CORNERS]
        if not rest:
            return
        a, b, kind = rest[0] if reverse else rest[-1]
        x, y = at(a if reverse else b)
        k = 0 if kind == "Horizontal" else 1
        ahead = b[k] >= a[k]
        glyph = {(0, False): "▶◀", (0, True): "◀▶", (1, False): "▼▲", (1, True): "▲▼"}[(k, reverse)][0 if ahead else 1]
        step = (1 if ahead else -1) if reverse else (-1 if ahead else 1)
        put(x + (step if k == 0 else 0), y + (step if k else 0), glyph)

    of = lambda name: sorted(p for p in paths if p[0] == name)
    for p in of("edge") + of("merged"):
        lines(p[3])
    seen = set()
    for p in of("edge") + (of("merged") if reverse else []):
        key = p[1] if reverse else p[2]
        if key not in seen:
            seen.add(key)
            head(p[3])
    for p in of("trunk"):
        lines(p[3])
        if not reverse:
            head(p[3])
    for p in of("cross"):
        lines(p[3])
    return grid


def test_a_layout_of_some_nodes_is_painted_as_by_hand(spark):
    rng = random.Random(4)
    nodes = spark.range(9).withColumnRenamed("id", "idx")
    edges = sorted({(a, b) for a, b in ((rng.randrange(9), rng.randrange(9)) for _ in range(26)) if a // 3 < b // 3} | {(8, 0)})
    _, paths = layout.layout(nodes, spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "src long, dst long, ord long"), painter.VIEW)
    rows = [(p["class"], p.parent_id, p.child_id, [((s["from"].x, s["from"].y), (s.to.x, s.to.y), s.type) for s in p.segments]) for p in paths.collect()]
    paths = spark.createDataFrame(rows, PATHS)
    for offset, scale, reverse in (((0.0, -40.0), 1.0, False), ((0.0, -40.0), 1.0, True), ((17.3, -9.5), 0.4, False)):
        got = {(r.x, r.y): r.glyph for r in painter.painted(paths, 160, 80, offset, scale, reverse).collect()}
        want = plain(rows, 160, 80, offset, scale, reverse)
        assert len(want) > 60 and got == want


def graph(spark, calls):
    names = sorted({n for c in calls for n in c} | {"far", "away"})
    functions = spark.createDataFrame([(i, n, n, n, ("f.c", i, 0, None)) for i, n in enumerate(names)], FUNCTIONS)
    return CallGraph(functions, spark.createDataFrame([(i, a, b, ("f.c", i, 0, None)) for i, (a, b) in enumerate(calls)], CALLS), None, None)


def test_views_are_laid_out_when_they_have_changed(spark):
    calls = [("main", "a"), ("a", "b"), ("main", "b"), ("b", "c")]
    view = painter.GraphView("b")
    assert view.update(graph(spark, calls), (80, 24)) and view.version == 1
    assert {(r.idx, r.x) for r in view.positions.collect()} == {(0, 0.0), (1, 36.0), (2, 72.0)}
    assert view.offset == (0.0, view.place_of_root()[1] - 11)
    assert not view.update(graph(spark, [*calls, ("c", "far"), ("far", "away")]), (80, 24)) and view.version == 1
    assert view.painted(120, 24).filter(F.col("glyph").isin("◀", "▶")).count() > 0
    view.recenter((80, 24))
    assert view.offset == (-40.0, view.place_of_root()[1] - 12)
    view.turn_round()
    assert view.update(graph(spark, [*calls, ("b", "a")]), (80, 24)) and view.version == 2 and {r.id for r in view.nodes.collect()} == {"a", "b", "c"}


def test_errors_and_other_cross_edges(spark):
    nodes = spark.range(3).withColumnRenamed("id", "idx")
    edges = lambda *e: spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(e)], "src long, dst long, ord long")
    with pytest.raises(layout.InvalidNode, match="Invalid node index: 7"):
        layout.layout(nodes, edges((0, 7)))
    with pytest.raises(layout.EmptyTree, match="Empty tree provided"):
        layout.layout(nodes.limit(0), edges((0, 1)))
    with pytest.raises(layout.ConfigError, match="Configuration error"):
        layout.LayoutConfig(node_separation=-1)
    with pytest.raises(layout.InvalidTree, match="Invalid tree structure"):
        layout.layers(nodes, edges((0, 1), (1, 0)))
    positions, paths = layout.layout(nodes, edges((0, 1), (1, 2), (2, 0)))
    other = layout.with_cross_edges(paths, positions, edges((0, 2), (0, 9)))
    assert {(r.parent_id, r.child_id) for r in layout.paths_of(other, "cross").collect()} == {(0, 2)}
    assert other.filter("class <> 'cross'").count() == paths.filter("class <> 'cross'").count()
