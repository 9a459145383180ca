import json

import pandas as pd
from pyspark.sql import functions as F

from callweave.graph import CallGraph
from callweave.operators import filters, search
from callweave.sources import files, messages


def built(spark, **columns):
    row = spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()
    return {k: json.loads(row[k]) for k in columns}


def test_each_request_is_built_as_it_is_sent(spark):
    uri, n = F.lit("file:///a.c"), F.lit(7)
    enhanced, pending = messages.enhanced_references_request(n, uri, F.lit(3), F.lit(4))
    got = built(
        spark, references=messages.references_request(n, uri, F.lit(3), F.lit(4)), enhanced=enhanced, hover=messages.hover_request(n, uri, F.lit(3), F.lit(4)),
        prepare=messages.prepare_request(n, uri, F.lit(0), F.lit(0)), out=messages.calls_request(n, F.struct(F.lit("f").alias("name")), True), into=messages.calls_request(n, F.struct(F.lit("f").alias("name")), False),
        workspace=messages.workspace_request(n, F.lit("q")), symbols=messages.symbols_request(n, uri), initialized=messages.initialized(),
        opened=messages.did_open(uri, F.lit("c"), F.lit(1), F.lit('a "b"\n')), closed=messages.did_close(uri), start=messages.initialize_request(n, F.lit("file:///home/project"), 42, "client", "1.0"))
    doc, at = {"textDocument": {"uri": "file:///a.c"}}, {"position": {"line": 3, "character": 4}}
    sent = lambda method, params: {"jsonrpc": "2.0", "id": 7, "method": method, "params": params}
    told = lambda method, params: {"jsonrpc": "2.0", "method": method, "params": params}
    references = sent("textDocument/references", {**doc, **at, "context": {"includeDeclaration": True}})
    assert got == {
        "references": references, "enhanced": references, "hover": sent("textDocument/hover", {**doc, **at}),
        "prepare": sent("textDocument/prepareCallHierarchy", {**doc, "position": {"line": 0, "character": 0}}),
        "out": sent("callHierarchy/outgoingCalls", {"item": {"name": "f"}}), "into": sent("callHierarchy/incomingCalls", {"item": {"name": "f"}}),
        "workspace": sent("workspace/symbol", {"query": "q"}), "symbols": sent("textDocument/documentSymbol", doc), "initialized": told("initialized", {}),
        "opened": told("textDocument/didOpen", {"textDocument": {"uri": "file:///a.c", "languageId": "c", "version": 1, "text": 'a "b"\n'}}),
        "closed": told("textDocument/didClose", doc), "start": got["start"]}
    start = got["start"]
    assert start["method"] == "initialize" and start["params"]["processId"] == 42 and start["params"]["clientInfo"] == {"name": "client", "version": "1.0"}
    assert start["params"]["workspaceFolders"] == [{"uri": "file:///home/project", "name": "project"}]
    assert spark.range(1).select(pending).first()[0] == messages.REFERENCES[1]


def test_an_enhanced_answer_has_locations(spark):
    sent = spark.createDataFrame([(json.dumps({"jsonrpc": "2.0", "id": 1, "result": [{"uri": "file:///b.c", "range": {"start": {"line": 1, "character": 1}, "end": {"line": 1, "character": 3}}}]}),)], "value string")
    pending = spark.createDataFrame([(1, messages.REFERENCES[1])], "id long, method string")
    assert messages.locations(messages.answers(messages.envelopes(sent), pending, messages.REFERENCES)).count() == 1


def test_a_window_of_results_follows_the_selection(spark):
    assert [search.scroll_offset(s, 5, 10) for s in (0, 4, 5, 14, 15, 40)] == [0, 4, 5, 5, 6, 31]
    results = spark.createDataFrame([(str(i), f"n{i:02}", 1.0 - i / 100) for i in range(30)], "id string, name string, score double")
    shown = search.scrolled(results, search.scroll_offset(12, 0, 5), 5).orderBy("at").collect()
    assert [(r.at, r.id) for r in shown] == [(i, str(i)) for i in range(8, 13)]


def test_predicates_of_any_kind(spark):
    g = files.demo_graph(spark)
    short = lambda pdf: pdf["name"].str.len() <= 10
    deep = lambda pdf: pdf["qualified_name"].str.count("::") > 0
    want = {r.name for r in g.functions.collect() if len(r.name) <= 10 and "::" in r.qualified_name}
    assert {r.name for r in filters.where_all(g, short, deep).collect()} == want and want
    assert filters.where_all(g).count() == g.functions.count()
    assert filters.where_all(g, lambda pdf: pd.Series([None] * len(pdf))).count() == 0


def test_a_graph_comes_back_from_json(spark, tmp_path):
    g = files.demo_graph(spark)
    files.write_graph_json(g, str(tmp_path / "g"))
    back = files.load_graph_json(spark, str(tmp_path / "g"))
    for name in files.TABLES:
        assert sorted(map(str, getattr(back, name).collect())) == sorted(map(str, getattr(g, name).collect())), name
    files.write_graph_json(CallGraph.empty(spark), str(tmp_path / "none"))
    assert files.load_graph_json(spark, str(tmp_path / "none")).calls.count() == 0
