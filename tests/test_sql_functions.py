import pytest
from pyspark.errors import AnalysisException
from test_graph import dfs_paths, graph

from callweave.operators import sql_functions, traversal
from callweave.storage import keep

CALLS = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("d", "d"), ("x", "a")]


@pytest.fixture(scope="module")
def registered(spark):
    g = graph(spark, ["a", "b", "c", "d", "x"], CALLS)
    sql_functions.register(g, "small", g.functions.filter("id in ('a', 'd')").select("id"))
    return lambda sql: sorted(tuple(r) for r in spark.sql(sql).collect())


def test_call_sites_by_table_function(registered):
    assert registered("SELECT id FROM small_callees_of('a')") == [("b",), ("b",), ("c",)]
    assert registered("SELECT f.id, c.id FROM small_functions f, LATERAL small_callers_of(f.id) c") == sorted((d, s) for s, d in CALLS)


@pytest.mark.parametrize("head,tail,most", [("a", "d", 1), ("a", "d", 3), ("a", "d", 5), ("x", "d", 6), ("a", "a", 3), ("d", "a", 5), ("none", "d", 4)])
def test_simple_paths_are_those_of_a_walk(registered, head, tail, most):
    found = registered(f"SELECT path FROM small_simple_paths('{head}', '{tail}', {most})")
    assert [p for (p,) in found] == dfs_paths(CALLS, head, tail, most)


def test_no_path_of_no_depth(registered):
    assert registered("SELECT path FROM small_simple_paths('a', 'a', 0)") == []


def test_walks_of_starts(registered):
    assert registered("SELECT id, depth FROM small_reachable_from('a')") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert registered("SELECT id, depth FROM small_can_reach('d')") == [("a", 2), ("b", 2), ("c", 1), ("d", 0), ("x", 3)]
    assert registered("SELECT id, depth FROM small_reachable_from('x')") == []


def test_a_query_keeps_the_graph_it_was_stated_over(spark):
    sql_functions.register(graph(spark, ["a", "b"], [("a", "b")]), "again")
    first = spark.sql("SELECT id FROM again_callees_of('a')")
    sql_functions.register(graph(spark, ["a", "c"], [("a", "c")]), "again")
    assert [r.id for r in first.collect()] == ["b"] and [r.id for r in spark.sql("SELECT id FROM again_callees_of('a')").collect()] == ["c"]
    with pytest.raises(AnalysisException):
        spark.sql("SELECT id FROM again_reachable_from('a')")


def test_walks_of_many_starts_share_rows(spark, monkeypatch):
    """More starts than a row has bits: each walk is its own, what many reach is a row for each block of them, and edges aren't written again."""
    n, written = 70, []
    rows = [(f"s{i}", "hub") for i in range(n)] + [(f"s{i}", f"s{i + 1}") for i in range(0, n - 1, 2)] + [("hub", f"t{i}") for i in range(30)] + [("t3", "s5")]
    ids = sorted({x for r in rows for x in r})
    g = graph(spark, ids, rows)

    def kept(df):
        written.append(keep(df))
        return written[-1]

    monkeypatch.setattr(traversal, "keep", kept)
    sql_functions.register(g, "many", g.functions.filter("id like 's%'").select("id"))
    found = {}
    for r in spark.sql("SELECT f.id AS start, r.id, r.depth FROM many_starts f, LATERAL many_reachable_from(f.id) r").collect():
        assert (r.start, r.id) not in found
        found[r.start, r.id] = r.depth
    want = {}
    for s in (i for i in ids if i.startswith("s")):
        level, depth = {s}, 0
        while level:
            want |= {(s, x): depth for x in level}
            level, depth = {d for a, d in rows if a in level and (s, d) not in want}, depth + 1
    assert found == want and spark.table("many_starts").count() == n
    assert max(df.count() for df in written if "bits" in df.columns) <= 2 * len(ids) and not any("dst" in df.columns for df in written)
