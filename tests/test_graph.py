import random
import uuid
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from callweave import schema
from callweave.functions import ids, text
from callweave.graph import CallGraph
from callweave.operators import filters, navigation, paths, reports, search, traversal
from callweave.sources.files import demo_graph
from callweave.storage import bucketed, keep


def graph(spark, names, calls, diagnostics=()):
    functions = [(i, n, n, n, (f"{n}.rs", 1, 0, None)) for i, n in enumerate(names)]
    sites = [(i, a, b, ("f.rs", i, 4, None)) for i, (a, b) in enumerate(calls)]
    found = [(i, f, (f"{f}.rs", 3, 0, None), s, "m", "c") for i, (f, s) in enumerate(diagnostics)]
    make = spark.createDataFrame
    return CallGraph(make(functions, schema.FUNCTIONS), make(sites, schema.CALLS), make([], schema.REFERENCES), make(found, schema.DIAGNOSTICS))


def column(df, name="id"):
    return sorted(r[name] for r in df.collect())


def dfs_paths(edges, start, end, most):
    out = []

    def go(path):
        if len(path) - 1 >= most:
            return
        if path[-1] == end:
            out.append(path)
            return
        for s, d in edges:
            if s == path[-1] and d not in path:
                go([*path, d])

    go([start])
    return sorted(out)


def dfs_cycles(edges, start, most):
    out = []

    def go(path):
        for s, d in edges:
            if s == path[-1]:
                if d in path:
                    out.append([*path[path.index(d):], d])
                elif len(path) < most:
                    go([*path, d])

    if most:
        go([start])
    return sorted(out)


def test_chain(spark):
    g = graph(spark, "abc", ["ab", "bc"])
    assert column(traversal.reachable(g.edges, "a")) == list("abc")
    assert column(traversal.reachable(g.reversed_edges, "c")) == list("abc")
    assert traversal.shortest_path(g.sites, "a", "c").first().path == list("abc")
    assert traversal.shortest_path(g.sites, "c", "a").collect() == []
    assert traversal.shortest_path(g.sites, "a", "a").first().path == ["a"]
    assert [column(traversal.at_depth(g.edges, "a", d)) for d in range(4)] == [["a"], ["b"], ["c"], []]
    assert column(traversal.reachable(g.edges, "nobody")) == ["nobody"]


def test_cycle_and_analysis(spark):
    g = graph(spark, "abc", ["ab", "bc", "ca"])
    assert len(traversal.shortest_paths(g.sites, "a").collect()) == 3
    assert [r.cycle for r in paths.cycles(g.edges, "a", 5).collect()] == [list("abca")]
    assert tuple(paths.path_analysis(g.sites, "a").first()) == (3, 2, 1.0)


@pytest.mark.parametrize("seed", range(2))
def test_paths_and_cycles_equal_a_depth_first_walk(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.choice("abcdef"), rng.choice("abcdef")) for _ in range(12)]
    df = spark.createDataFrame(edges, "src string, dst string")
    for most in (0, 1, 3, 4):
        assert sorted(r.path for r in paths.all_paths(df, "a", "d", most).collect()) == dfs_paths(edges, "a", "d", most)
        assert sorted(r.cycle for r in paths.cycles(df, "a", most).collect()) == dfs_cycles(edges, "a", most)


def test_reports(spark):
    g = graph(spark, ["main", "helper", "error_prone", "leaf"], [("main", "helper"), ("main", "error_prone"), ("helper", "leaf")], [("helper", 2), ("error_prone", 1)])
    assert reports.graph_stats(g).first().asDict() == {"total_functions": 4, "total_calls": 3, "entry_points": 1, "leaf_functions": 2, "with_diagnostics": 2, "avg_calls": 0.75}
    info = reports.function_info(g, "main").first()
    assert (info.n_callers, info.n_callees, info.n_reachable, info.n_can_reach, info.has_diagnostics) == (0, 2, 4, 1, False)
    assert tuple(reports.impact(g, "helper", 3)[0].first()) == (1, 2, 3)
    dep = reports.dependencies(g, "main", 3).first()
    assert (dep.direct, dep.total) == (2, 4)
    assert sorted(map(tuple, reports.problem_areas(g).collect())) == [("error", "error_prone"), ("warning", "helper")]
    assert column(reports.search_functions(g, "main")) == ["main"]
    assert reports.function_info(g, "nobody").collect() == []
    assert column(filters.with_severity(g, 1)) == ["error_prone"]


def test_empty_self_loops_and_missing_ends(spark):
    empty = CallGraph.empty(spark)
    assert reports.graph_stats(empty).first().avg_calls == 0.0
    g = graph(spark, "ab", ["aa", "ax", "xb"])
    assert column(filters.entry_points(g)) == ["b"]
    assert column(filters.leaves(g)) == ["b"]
    assert {r.id: (r.n_callers, r.n_callees) for r in g.degrees().collect()} == {"a": (1, 1), "b": (0, 0)}
    assert column(g.resolved_calls, "callee") == ["a"]


def test_first_wins_and_demo(spark):
    g = demo_graph(spark)
    again = g.add_functions(g.functions.withColumn("name", F.lit("other")).withColumn("seq", F.col("seq") + 100)).add_calls(g.calls)
    assert again.functions.filter("name = 'other'").count() == 0
    assert (again.functions.count(), again.calls.count()) == (7, 8)
    assert g.callers("helper_function").count() >= 3 and g.callees("helper_function").count() == 0
    assert column(filters.with_references(g, 2)) == ["helper_function", "process_data"]
    assert g.function_by_name("cleanup").first().qualified_name == "cleanup::cleanup"


def test_dag_and_navigation(spark):
    g = graph(spark, "abcd", ["ab", "ac", "bd", "cd", "da"])
    nodes, edges = traversal.dag(g.sites, g.functions.select("id"), "a", 2)
    assert [(r.idx, r.id, r.depth) for r in nodes.orderBy("idx").collect()] == [(0, "a", 0), (1, "b", 1), (2, "c", 1), (3, "d", 2)]
    assert sorted((r.src, r.dst) for r in edges.collect()) == [(0, 1), (0, 2), (1, 3), (2, 3)]
    assert {(r.parent, r.idx): (r.next, r.previous) for r in navigation.siblings(edges).collect()}[(0, 2)] == (1, 1)
    assert {r.parent: r.child for r in navigation.middle_children(edges).collect()} == {0: 1, 1: 3, 2: 3}
    assert {r.idx: r.parent for r in navigation.active_parents(edges, 1).collect()}[3] == 2
    with pytest.raises(ValueError):
        traversal.dag(g.sites, g.functions.select("id"), "nobody")
    with pytest.raises(ValueError):
        traversal.check_edges(nodes, edges.unionByName(spark.createDataFrame([(0, 99, 0)], edges.schema)))


def fuzzy(pattern, word):
    at, first = -1, None
    for c in pattern.lower():
        at = word.lower().find(c, at + 1)
        if at < 0:
            return None
        first = at if first is None else first
    import math

    return len(pattern) / len(pattern.encode()) / max(math.log2(first + 1), 1) / (at - first + 1)


def test_fuzzy_search_equals_brute_force(spark):
    words = ["process_data", "prd", "paradise", "Product", "xxprd", "none", "übergabe", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for pattern in ("prd", "p", "be", "ü"):
        got = {r.w: r.s for r in df.select("w", text.fuzzy_score(F.lit(pattern), F.col("w")).alias("s")).collect()}
        assert got == pytest.approx({w: fuzzy(pattern, w) for w in words})
    g = graph(spark, ["process_data", "prd", "other"], [])
    assert [r.id for r in search.search(g, "prd").collect()] == ["prd", "process_data"]


def test_scalars(spark):
    cases = {"int foo(int x)": "foo", "void bar()": "bar", "int* get_pointer()": "get_pointer", "const char *get_name(void)": "get_name", "static int my_func(const char* s)": "my_func", "nothing": None, "": None, "()": None}
    df = spark.createDataFrame(list(cases.items()), "s string, n string")
    assert df.filter(~text.name_of_signature(F.col("s")).eqNullSafe(F.col("n"))).collect() == []
    row = spark.range(1).select(
        ids.symbol_id(F.lit("a::b"), F.lit("x.c"), F.lit(3)).alias("id"), ids.path_of_uri(F.lit("file:///a%20b/c+d.c")).alias("path"),
        ids.call_qualified_name(F.lit(""), F.lit("n")).alias("q"), ids.detailed_name(F.lit(None).cast("string"), F.lit("n")).alias("d"), ids.language_of(F.lit("a/b.hpp")).alias("l"),
        text.text_of_markup(F.lit("markdown"), F.lit("# T\nint foo(int)\n")).alias("m"), text.node_label(F.lit("x" * 30)).alias("t")).first()
    assert row.id == str(uuid.uuid5(uuid.NAMESPACE_OID, "a::b@x.c:3"))
    assert (row.path, row.q, row.d, row.l, row.m, row.t) == ("/a b/c+d.c", "n", "::n", "c", "foo", "x" * 21 + "…")


def test_wide_levels_walk_over_buckets(spark, monkeypatch):
    """A source with most of the edges is spread over salts; edges put into buckets give what edges that stay give."""
    rows = [("hub", f"n{i}") for i in range(400)] + [(f"n{i}", f"n{(7 * i + 3) % 450}") for i in range(450)] + [("n5", "hub"), ("n9", "hub"), ("alone", "n1")]
    edges = spark.createDataFrame(rows, "src string, dst string")
    want = sorted(traversal.call_depth(edges, "n5").collect())
    both = sorted(traversal.both_ways(edges, "n5").collect())
    monkeypatch.setattr(traversal, "WIDE", 1)
    roads = traversal.Roads(edges)
    split, hubs = roads._split()
    assert split.count() == len(rows) and [r.id for r in hubs.collect()] == ["hub"]
    assert split.filter("src = 'hub'").select("salt").distinct().count() > 1
    assert sorted(traversal.call_depth(edges, "n5").collect()) == want
    assert sorted(traversal.both_ways(edges, "n5").collect()) == both
    after, before, todo = {"n5"}, {"n5"}, 500
    for _ in range(todo):
        after |= {d for s, d in rows if s in after}
        before |= {s for s, d in rows if d in before}
    assert {r.id for r in both if r.on} == after == {r.id for r in want} and {r.id for r in both if not r.on} == before


def test_buckets_spare_the_shuffle(spark):
    edges = spark.createDataFrame([(i % 50, i) for i in range(500)], "src long, dst long")
    left, right = bucketed(edges, ["src"]), bucketed(edges.withColumnRenamed("dst", "other"), ["src"])
    plan = left.hint("merge").join(right, "src")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and left.join(right, "src").count() == 5000


def test_siblings_across_ranges(spark):
    """Families that end at, cross and fill ranges of the sorted children."""
    rows = [(p, 1000 * p + k, k) for p, n in ((1, 1), (2, 37), (3, 2), (4, 150), (5, 3)) for k in range(n)]
    found = {(r.parent, r.idx): (r.next, r.previous) for r in navigation.siblings(spark.createDataFrame(rows, "src long, dst long, ord long").repartition(7)).collect()}
    sizes = {1: 1, 2: 37, 3: 2, 4: 150, 5: 3}
    assert found == {(p, d): (1000 * p + (k + 1) % sizes[p], 1000 * p + (k - 1) % sizes[p]) for p, d, k in rows}


def test_siblings_at_borders_of_ranges(spark):
    """A family that fills several ranges: neighbours on both sides of each border."""
    rows = [(1, 100 + k, k) for k in range(60)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small ranges would be put together
    try:
        found = {r.idx: (r.next, r.previous) for r in navigation.siblings(spark.createDataFrame(rows, "src long, dst long, ord long")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert found == {d: (100 + (k + 1) % 60, 100 + (k - 1) % 60) for _, d, k in rows}


def test_siblings_move_once(spark, monkeypatch):
    """Children go to their parent and are neither sorted in ranges nor written, but for those of a parent with very many, beside which repeats and no parent count as in SQL."""
    families = {1: 1, 2: 37, 3: 2, 4: 150, None: 3}
    rows = [(p, 1000 * (p or 9) + k, k) for p, n in families.items() for k in range(n)] + [(3, 3001, 1)]
    edges = spark.createDataFrame(rows, "src long, dst long, ord long").repartition(7)
    want = sorted((str(p), 1000 * (p or 9) + k, 1000 * (p or 9) + (k + 1) % n, 1000 * (p or 9) + (k - 1) % n) for p, n in families.items() if p != 3 for k in range(n))
    want = sorted(want + [("3", 3000, 3001, 3001), ("3", 3001, 3001, 3000), ("3", 3001, 3000, 3001)])
    found = lambda: sorted((str(r.parent), r.idx, r.next, r.previous) for r in navigation.siblings(edges).collect())
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small ranges would be put together
    try:
        monkeypatch.setattr(navigation, "HUB", 30)
        assert found() == want
        monkeypatch.setattr(navigation, "numbered", None)
        monkeypatch.setattr(navigation, "HUB", 150)
        assert found() == want
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_degrees_move_sites_by_their_ends(spark):
    """Sites aren't counted by pairs, which are nearly as many; ends that aren't there or are null, repeats and calls of itself count as they did."""
    function = lambda i: (i, f"f{i}", f"f{i}", f"f{i}", None)
    calls = [(0, "f0", "f1"), (1, "f0", "f1"), (2, "f1", "f1"), (3, "f0", "gone"), (4, "gone", "f2"), (5, None, "f2"), (6, "f2", None)]
    g = CallGraph.empty(spark).add_functions(spark.createDataFrame([function(i) for i in range(4)], schema.FUNCTIONS))
    g = replace(g, calls=spark.createDataFrame([(*c, None) for c in calls], schema.CALLS))
    assert {r.id: (r.n_callers, r.n_callees) for r in g.degrees().collect()} == {"f0": (0, 2), "f1": (3, 1), "f2": (0, 0), "f3": (0, 0)}
    assert "keys=[caller" not in g.degrees()._jdf.queryExecution().executedPlan().toString()


def test_sites_are_kept_as_they_are_for_paths(spark, monkeypatch):
    """No pass over all sites finds the first of each pair, nor those that lead to known ids: what is reached is looked at only."""
    sites = spark.createDataFrame([("a", "b", 5), ("a", "b", 2), ("a", "c", 3), ("b", "d", 9), ("c", "d", 1), ("a", "x", 0), ("x", "d", 0)], "src string, dst string, seq long")
    plans = []
    monkeypatch.setattr(traversal, "keep", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    known = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    nodes, edges = traversal.dag(sites, known, "a")
    assert [(r.idx, r.id) for r in nodes.orderBy("idx").collect()] == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, edges.collect())) == [(0, 1, 2), (0, 1, 5), (0, 2, 3), (1, 3, 9), (2, 3, 1)]
    assert {r.id: r.path for r in traversal.shortest_paths(sites.filter("dst <> 'x'"), "a").collect()}["d"] == ["a", "b", "d"]
    assert "Aggregate" not in plans[0] and "Join" not in plans[0]


def test_info_moves_edges_for_wide_directions_alone(spark, monkeypatch):
    """Edges are written as they are, repeats and all, and put into buckets for the way out, which is wide, not for the way back, which is narrow."""
    calls = [("up", "a")] + [("a", f"n{i % 40}") for i in range(400)] + [(f"n{i}", "leaf") for i in range(40)]
    g = graph(spark, ["up", "a", "leaf", *[f"n{i}" for i in range(40)]], calls, [("a", 1), ("leaf", 2)])
    moved, written = [], []
    monkeypatch.setattr(traversal, "WIDE", 10)
    monkeypatch.setattr(traversal, "bucketed", lambda df, by: moved.append(bucketed(df, by)) or moved[-1])
    for module in (traversal, reports):
        monkeypatch.setattr(module, "keep", lambda df: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    info = reports.function_info(g, "a").first()
    assert (info.n_callers, info.n_callees, info.n_reachable, info.n_can_reach, info.n_errors) == (1, 400, 42, 2, 1)
    assert len(moved) == 1 and moved[0].groupBy("src", "dst").count().filter("src = 'a' and count > 1").isEmpty()
    assert "Aggregate" not in written[0]
