import json

from pyspark.sql import functions as F

from callweave.operators import containment
from callweave.sources import files, messages
from callweave.streaming import ingest


def rng(a, b, c, d):
    return {"start": {"line": a, "character": b}, "end": {"line": c, "character": d}}


def asked(spark, method, *bodies):
    sent = spark.createDataFrame([(json.dumps({"jsonrpc": "2.0", "id": i, **b}),) for i, b in enumerate(bodies)], "value string")
    return messages.answers(messages.envelopes(sent), spark.createDataFrame([(i, method) for i in range(len(bodies))], "id long, method string"), (method,))


def test_reference_answers(spark):
    rows = asked(spark, messages.REFERENCES[0], {"result": [{"uri": "file:///home/u/t.rs", "range": rng(10, 5, 10, 15)}, {"uri": "file:///b", "range": rng(10, 20, 12, 5)}]}, {"result": None}, {"error": {"code": 1, "message": "no"}}, {"error": {"code": 2}})
    got = [(r.id, r.location.file_path, r.location.line, r.location.column, r.location.length) for r in messages.locations(rows).orderBy("id", "at").collect()]
    assert got == [(0, "/home/u/t.rs", 11, 6, 10), (0, "/b", 11, 21, None)]
    assert sorted(map(tuple, messages.errors(rows).collect())) == [(2, "no"), (3, messages.UNKNOWN_ERROR)]


def test_nested_symbols_and_containment(spark):
    tree = [{"name": "A", "kind": 5, "range": rng(0, 0, 20, 0), "selectionRange": rng(0, 6, 0, 7), "children": [{"name": "m", "kind": 6, "range": rng(2, 0, 5, 0), "selectionRange": rng(2, 4, 2, 5)}]}, {"name": "f", "kind": 12, "range": rng(3, 0, 30, 0), "selectionRange": rng(3, 0, 3, 1)}]
    found = messages.document_symbols(asked(spark, "textDocument/documentSymbol", {"result": tree}))
    assert [(r.path, r.qualified_name) for r in found.orderBy("path").collect()] == [([0], "A"), ([0, 0], "A::m"), ([1], "f")]
    symbols = found.select(F.lit("x.c").alias("file"), "path", "range", "around", F.col("name").alias("symbol"))
    at = spark.createDataFrame([(i, "x.c", (line, 0)) for i, line in enumerate((3, 10, 25, 40))] + [(9, "other", (3, 0))], "pos_id long, file string, at struct<line:int,character:int>")
    assert {r.pos_id: r.symbol for r in containment.containing_symbol(at, symbols).collect()} == {0: "m", 1: "A", 2: "f", 3: None, 9: None}


def test_calls_and_workspace(spark):
    item = {"name": "callee", "kind": 12, "detail": "ns", "uri": "file:///c.c", "range": rng(4, 0, 6, 1), "selectionRange": rng(4, 4, 4, 8)}
    rows = asked(spark, "callHierarchy/outgoingCalls", {"result": [{"to": item, "fromRanges": [rng(1, 2, 1, 8), rng(2, 2, 2, 8)]}]})
    site = messages.call_sites(rows, True, spark.createDataFrame([(0, "/a.c")], "id long, file_path string")).orderBy("call_location").first()
    assert (site.item.qualified_name, site.item.definition_location.line, site.call_location.file_path, site.call_location.line) == ("ns::callee", 5, "/a.c", 2)
    ws = messages.workspace_symbols(asked(spark, "workspace/symbol", {"result": [{"name": "f", "kind": 12, "containerName": "k", "location": {"uri": "file:///w.c"}}, {"name": "v", "kind": 13, "location": {"uri": "file:///w.c", "range": rng(1, 1, 1, 2)}}]}))
    assert [(r.qualified_name, r.location.line) for r in ws.orderBy("at").collect()] == [("k::f", 0), ("v", 2)]
    assert messages.loadable(ws).count() == 1
    text = spark.range(1).select(messages.framed(messages.request(F.col("id"), "m", F.struct(F.lit("é").alias("q")))).alias("t")).first().t
    head, body = text.split("\r\n\r\n")
    assert head == f"Content-Length: {len(body.encode())}" and json.loads(body)["params"] == {"q": "é"}
    kinds = spark.createDataFrame([(json.dumps(x),) for x in ([], [{"uri": "u", "range": {}}], [{"to": {}, "fromRanges": []}], [{"name": "n", "range": {}}])], "j string")
    assert [r[0] for r in kinds.select(messages.sniffed_kind(F.col("j"))).collect()] == ["references", "references", "outgoing", "document"]


def test_files(spark, tmp_path):
    (tmp_path / "src" / "build").mkdir(parents=True)
    for name in ("a.c", "b.hpp", "c.txt", "build/d.c"):
        (tmp_path / "src" / name).write_text("x")
    (tmp_path / "compile_commands.json").write_text(json.dumps([{"directory": str(tmp_path / "src"), "command": "cc", "file": "a.c"}, {"directory": "/", "file": "/no/such.c"}]))
    walked = files.source_files(spark, str(tmp_path / "src"))
    assert [r.path.rsplit("/", 1)[1] for r in walked.collect()] == ["a.c", "b.hpp"]
    assert [r.path for r in files.compile_commands(spark, str(tmp_path / "compile_commands.json"), walked).collect()] == [str(tmp_path / "src" / "a.c")]
    g = files.demo_graph(spark)
    files.save_graph(g, str(tmp_path / "g"))
    back = files.load_graph(spark, str(tmp_path / "g"))
    assert sorted(back.calls.collect()) == sorted(g.calls.collect()) and back.diagnostics.count() == 4
    (tmp_path / "g.json").write_text(json.dumps({"nodes": {"i": {"name": "f", "qualified_name": "f"}}, "edges": [{"caller": "i", "callee": "i"}] * 2}))
    assert files.read_graph_json(spark, str(tmp_path / "g.json")).calls.count() == 1


def test_project_paths(spark):
    paths = spark.createDataFrame([("/p/src/main.c",), ("src",), ("",), ("/q/x.c",), (None,)], "path string")
    project = spark.createDataFrame([("/p/src/main.c",), ("rc/ma",), (None,)], "f string")
    assert sorted(r.path for r in containment.project_paths(paths, "path", project).collect()) == ["", "/p/src/main.c", "src"]
    assert containment.project_paths(paths, "path", project.limit(0)).count() == 5


def test_streams(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (0, "a"), (2, "b")], "seq long, id string").coalesce(1).write.parquet(f"{source}/one")
    spark.createDataFrame([(5, "b"), (6, "c")], "seq long, id string").coalesce(1).write.parquet(f"{source}/two")
    read = lambda: spark.readStream.schema("seq long, id string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):
        ingest.grow(read(), out, str(tmp_path / "cp"), ["id"]).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    requests = spark.sql("SELECT * FROM VALUES (1, 'x', timestamp'2024-01-01 00:00:00'), (2, 'y', timestamp'2024-01-01 00:00:00') AS t(request_id, symbol_id, ts)")
    responses = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 00:00:30'), (2, timestamp'2024-01-01 00:00:31') AS t(request_id, ts)")
    assert {r.request_id: (r.state, r.reason) for r in ingest.outcomes(requests, responses).collect()} == {1: ("Loaded", None), 2: ("Failed", "Request timed out")}
    parts = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "base_id int, part_id int")
    expected = spark.createDataFrame([(1, 2), (2, 2), (3, 0)], "base_id int, n int")
    assert sorted(r.base_id for r in ingest.complete_groups(parts, expected).collect()) == [1, 3]


def test_requests_are_answered_once_on_a_stream(spark, tmp_path):
    """The first answer in time wins; a request without one fails once the watermark has passed."""
    from callweave.streaming import ingest

    stamp = lambda n: f"2024-01-01 00:{n // 60:02d}:{n % 60:02d}"
    asked = [(1, 0, "a"), (2, 5, "b"), (3, 6, "c"), (99, 300, "z")]
    got = [(1, 3, "first"), (1, 9, "second"), (2, 50, "late"), (98, 300, "none")]
    spark.createDataFrame([(i, stamp(t), s) for i, t, s in asked], "request_id long, ts string, symbol_id string").selectExpr("request_id", "timestamp(ts) ts", "symbol_id").coalesce(1).write.parquet(str(tmp_path / "q"))
    spark.createDataFrame([(i, stamp(t), s) for i, t, s in got], "request_id long, ts string, said string").selectExpr("request_id", "timestamp(ts) ts", "said").coalesce(1).write.parquet(str(tmp_path / "a"))
    read = lambda k, schema: spark.readStream.schema(schema).parquet(str(tmp_path / k))
    out = ingest.outcomes(read("q", "request_id long, ts timestamp, symbol_id string"), read("a", "request_id long, ts timestamp, said string"))
    q = out.writeStream.format("memory").queryName("outcomes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = {r.symbol_id: (r.state, r.reason) for r in spark.table("outcomes").collect()}
    assert rows == {"a": ("Loaded", None), "b": ("Failed", "Request timed out"), "c": ("Failed", "Request timed out")}
    assert spark.table("outcomes").count() == 3
    batch = ingest.matched(spark.read.parquet(str(tmp_path / "q")), spark.read.parquet(str(tmp_path / "a"))).collect()
    assert [(r.symbol_id, r.said) for r in batch] == [("a", "first")]


def test_answers_of_hierarchies_enter_the_graph(spark):
    from callweave.graph import CallGraph
    from callweave.sources import messages

    at = '{"start":{"line":4,"character":2},"end":{"line":4,"character":8}}'
    item = f'{{"name":"f","kind":12,"detail":"ns","uri":"file:///x.c","range":{at},"selectionRange":{at}}}'
    rows = spark.createDataFrame([(1, f'[{{"from":{item},"fromRanges":[{at},{at}]}}]', None), (2, "{}", None), (3, "null", None)], "id long, result string, error string")
    sites = messages.call_sites(rows.filter("id = 1"), outgoing=False)
    functions, calls = messages.found_calls(sites, spark.createDataFrame([(1, "me")], "id long, function_id string"), outgoing=False)
    g = CallGraph.empty(spark).add_functions(functions).add_calls(calls)
    f = g.functions.collect()
    assert [(x.qualified_name, x.definition_location.line) for x in f] == [("ns::f", 5)]
    assert [(c.caller, c.callee) for c in g.calls.collect()] == [(f[0].id, "me")]
    assert [r.id for r in messages.malformed(rows, messages.LOCATIONS).collect()] == [2]


def test_loading_keeps_its_deadlines(spark):
    from callweave.streaming import ingest

    rows = spark.sql("""SELECT 1 session_id, timestamp'2024-01-01 00:00:00' started, timestamp'2024-01-01 00:00:09' initialized, timestamp'2024-01-01 00:00:10' asked,
        array(named_struct('ts', timestamp'2024-01-01 00:00:11', 'name', 'a'), named_struct('ts', timestamp'2024-01-01 00:00:13', 'name', 'b')) symbols
        UNION ALL SELECT 2, timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 00:00:11', null, null""")
    assert sorted((r.session_id, r.phase, r.loaded) for r in ingest.loads(rows).collect()) == [(1, "Completed", 1), (2, "Failed", 0)]
    kept = ingest.since_refresh(rows.select(F.col("started").alias("ts"), "session_id"), rows.select(F.col("started").alias("ts")).limit(0))
    assert kept.count() == 2
