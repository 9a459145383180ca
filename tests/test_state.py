import json

import pandas as pd

from callweave.schema import FUNCTIONS
from callweave.streaming import ingest, state

FRAMES = [{"id": i, "text": "é€😀" * i} for i in range(6)]


def framed(body, kind=""):
    data = json.dumps(body, ensure_ascii=False).encode()
    return f"{kind}Content-Length: {len(data)}\r\n\r\n".encode() + data


def put(spark, rows, schema, path, *exprs):
    spark.createDataFrame(rows, schema).selectExpr(*(exprs or ["*"])).coalesce(1).write.mode("append").parquet(str(path))


def run(out, path, checkpoint):
    q = out.writeStream.format("parquet").option("path", str(path)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_frames_cut_at_every_byte(spark):
    """Two parts, cut anywhere, come out whole: inside of a header, a length, a blank line and a letter."""
    data = b"noise\r\n" + framed(FRAMES[2], "Content-Type: x\r\n") + b"Content-Length: none\r\n\r\n" + framed(FRAMES[3])
    rows = [(str(k), n, part) for k in range(len(data) + 1) for n, part in enumerate((data[:k], data[k:]))]
    found = state.frames(spark.createDataFrame(rows, "stream_id string, seq long, chunk binary")).collect()
    by = {}
    for r in found:
        by.setdefault(r.stream_id, []).append((r.at, json.loads(r.body)))
    assert len(by) == len(data) + 1 and all(sorted(v, key=str) == [(0, FRAMES[2]), (1, FRAMES[3])] for v in by.values())


def test_frames_wait_for_the_rest_after_a_restart(spark, tmp_path):
    data = b"".join(framed(f) for f in FRAMES)
    cuts = [data[i : i + 11] for i in range(0, len(data), 11)]
    half = len(cuts) // 2
    read = lambda: spark.readStream.schema("stream_id string, seq long, chunk binary").parquet(str(tmp_path / "in"))
    rows = [("a", n, c) for n, c in enumerate(cuts)]
    schema = "stream_id string, seq long, chunk binary"
    put(spark, rows[:half] + rows[half + 2 : half + 4], schema, tmp_path / "in")  # two chunks come before their turn
    state.use_state(spark)
    run(state.frames(read()), tmp_path / "out", tmp_path / "cp")
    first = spark.read.parquet(str(tmp_path / "out")).count()
    assert 0 < first < len(FRAMES)
    put(spark, rows[half - 2 : half + 2] + rows[half + 4 :], schema, tmp_path / "in")  # two come again
    run(state.frames(read()), tmp_path / "out", tmp_path / "cp")
    assert [(r.at, json.loads(r.body)) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect()] == list(enumerate(FRAMES))


STAMP = "timestamp_seconds(1704067200 + at) ts"


def test_parts_of_requests_on_a_stream(spark, tmp_path):
    """Complete with the last part, at once without any, given up by time; parts may come first, again and late."""
    base = "base_id string, at long, file_paths array<string>"
    part = "base_id string, at long, part string, payload string"
    put(spark, [("a", 1, ["x", "y", "x"]), ("b", 1, []), ("c", 2, ["x", "y"])], base, tmp_path / "base", "base_id", STAMP, "file_paths")
    put(spark, [("a", 0, "y", "early"), ("c", 3, "x", "cx"), ("c", 4, "x", "again")], part, tmp_path / "part", "base_id", STAMP, "part", "payload")
    read = lambda k, s: spark.readStream.schema(s).parquet(str(tmp_path / k))
    out = lambda: state.gathered(read("base", "base_id string, ts timestamp, file_paths array<string>"), read("part", "base_id string, ts timestamp, part string, payload string"))
    run(out(), tmp_path / "out", tmp_path / "cp")
    got = lambda: sorted((r.base_id, r.part or "", r.payload or "", r.why) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got() == [("b", "", "", "empty")]
    put(spark, [("a", 5, "x", "ax"), ("z", 100, "x", "moves the watermark")], part, tmp_path / "part", "base_id", STAMP, "part", "payload")
    run(out(), tmp_path / "out", tmp_path / "cp")
    want = [("a", "x", "ax", "complete"), ("a", "y", "early", "complete"), ("b", "", "", "empty"), ("c", "x", "cx", "timeout")]
    assert got() == want
    put(spark, [("c", 101, "y", "late"), ("a", 101, "x", "late")], part, tmp_path / "part", "base_id", STAMP, "part", "payload")
    run(out(), tmp_path / "out", tmp_path / "cp")
    assert got() == want
    files = spark.createDataFrame([("a", 1, ["x", "y", "x"])], base).selectExpr("base_id", STAMP, "file_paths")
    assert sorted((r.base_id, r.part) for r in state.asked_parts(files).select("base_id", "part").collect()) == [("a", "x"), ("a", "y")]


EVENT = "symbol_id string, at long, kind string, request_id string, items string, message string, generation long"
COLUMNS = ["symbol_id", STAMP, "kind", "request_id", "items", "message", "generation"]


def test_symbols_load_in_two_steps(spark, tmp_path):
    outgoing = True
    rows = [
        ("f", 0, "asked", "r1", None, None, 0), ("f", 1, "prepared", "r1", '[{"name":"é"},{"name":"second"}]', None, 0), ("f", 2, "calls", "r1", None, None, 0),
        ("f", 3, "calls", "r1/calls", None, None, 0), ("f", 4, "calls", "r1/calls", None, None, 0),
        ("g", 0, "asked", "r2", None, None, 0), ("g", 1, "prepared", "r2", "[]", None, 0),
        ("h", 0, "asked", "r3", None, None, 0), ("h", 1, "error", "r3", None, "no such file", 0),
        ("i", 0, "prepared", "r4", "[]", None, 0), ("j", 0, "asked", "r5", None, None, 0),
        ("k", 0, "asked", "r6", None, None, 0), ("k", 1, "refresh", None, None, None, 1), ("k", 2, "prepared", "r6", "[]", None, 1), ("k", 3, "asked", "r7", None, None, 0)]
    put(spark, rows, EVENT, tmp_path / "in", *COLUMNS)
    read = lambda: spark.readStream.schema("symbol_id string, ts timestamp, kind string, request_id string, items string, message string, generation long").parquet(str(tmp_path / "in"))
    run(state.symbol_states(read(), outgoing), tmp_path / "out", tmp_path / "cp")
    put(spark, [("z", 100, "refresh", None, None, None, 0)], EVENT, tmp_path / "in", *COLUMNS)
    run(state.symbol_states(read(), outgoing), tmp_path / "out", tmp_path / "cp")
    put(spark, [("j", 101, "prepared", "r5", "[]", None, 0)], EVENT, tmp_path / "in", *COLUMNS)
    run(state.symbol_states(read(), outgoing), tmp_path / "out", tmp_path / "cp")
    found = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("ts", "state").collect():
        found.setdefault(r.symbol_id, []).append((r.state, r.reason, r.send, r.item))
    loading = ("Loading", None, "prepare", None)
    assert found == {
        "f": [loading, ("Loading", None, "outgoing", '{"name":"é"}'), ("Loaded", None, None, None)],
        "g": [loading, ("Loaded", None, None, None)], "h": [loading, ("Failed", "no such file", None, None)],
        "j": [loading, ("Failed", state.TIMED_OUT, None, None)], "k": [loading, ("NotLoaded", None, None, None)], "z": [("NotLoaded", None, None, None)]}
    table = spark.read.parquet(str(tmp_path / "in"))
    last = state.symbol_states(table.filter("symbol_id = 'j'"), outgoing).orderBy("ts").collect()
    assert [(r.state, r.reason) for r in last] == [("Loading", None), ("Failed", state.TIMED_OUT)]


def answer(id_, result):
    return (json.dumps({"jsonrpc": "2.0", "id": id_, "result": result}),)


def spot(line):
    return {"start": {"line": line, "character": 2}, "end": {"line": line, "character": 8}}


def test_answers_change_the_graph_once(spark, tmp_path):
    """Calls are added, references replaced, also by none; a batch that is run again changes nothing."""
    item = {"name": "f", "kind": 12, "detail": "", "uri": "file:///f.c", "range": spot(4), "selectionRange": spot(4)}
    place = lambda n: {"uri": "file:///u.c", "range": spot(n)}
    pending = spark.createDataFrame([
        (1, "callHierarchy/outgoingCalls", "me", "/me.c"), (2, "textDocument/references", "me", None), (3, "workspace/symbol", None, None),
        (4, "textDocument/references", "me", None), (5, "callHierarchy/incomingCalls", "me", None), (6, "textDocument/references", "you", None), (7, "textDocument/references", "you", None)],
        "id long, method string, function_id string, file_path string")
    batches = [
        [answer(1, [{"to": item, "fromRanges": [spot(1), spot(1), spot(2)]}]), answer(2, [place(1), place(2)]), answer(6, [place(9)]), answer(99, [place(1)]), ("no json",)],
        [answer(3, [{"name": "w", "kind": 12, "containerName": "k", "location": place(3)}, {"name": "v", "kind": 13, "location": place(3)}]), answer(4, [place(7)])],
        [answer(5, [{"from": item, "fromRanges": [spot(5)]}]), answer(1, [{"to": item, "fromRanges": [spot(1)]}]), answer(7, None)]]
    read = lambda: spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    go = lambda checkpoint: ingest.put_answers(read(), pending, str(tmp_path / "g"), str(tmp_path / checkpoint)).awaitTermination(120)

    def graph():
        g = ingest.graph_at(spark, str(tmp_path / "g"))
        calls = sorted((c.caller, c.callee, c.call_location.file_path, c.call_location.line) for c in g.calls.collect())
        return sorted(f.qualified_name for f in g.functions.collect()), calls, sorted((r.function_id, r.location.line) for r in g.references.collect())

    seen = []
    for rows in batches:
        put(spark, rows, "value string", tmp_path / "in")
        go("cp")
        seen.append(graph())
    f = next(x.id for x in ingest.graph_at(spark, str(tmp_path / "g")).functions.collect() if x.name == "f")
    out = [("me", f, "/me.c", 2), ("me", f, "/me.c", 3)]
    assert seen[0] == (["f"], sorted(out), [("me", 2), ("me", 3), ("you", 10)])
    assert seen[1] == (["f", "k::w"], sorted(out), [("me", 8), ("you", 10)])
    assert seen[2] == (["f", "k::w"], sorted([*out, (f, "me", "/f.c", 6)]), [("me", 8)])
    go("again")  # without its checkpoint the stream runs all batches again
    assert graph() == seen[2]
    assert ingest.graph_at(spark, str(tmp_path / "g")).functions.columns == [c.split()[0] for c in FUNCTIONS.split(", ", 4)]


def test_batches_are_compacted(spark, tmp_path):
    """The rows stay, an earlier attempt is ended, the last batch stays apart, and the stream goes on."""
    read = lambda: spark.readStream.schema("seq long, id string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    go = lambda: ingest.grow(read(), str(tmp_path / "out"), str(tmp_path / "cp"), ["id"]).awaitTermination(120)
    ids = lambda: sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    for k in range(4):
        put(spark, [(k, "a"), (k, f"n{k}")], "seq long, id string", tmp_path / "in")
    go()
    want = ids()
    assert want == ["a", "n0", "n1", "n2", "n3"]
    (tmp_path / "out" / "_compact=1").mkdir()
    ingest.compact(spark, str(tmp_path / "out"), 99)
    folders = lambda: sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir())
    assert ids() == want and folders() == ["batch=2", "batch=3"]
    # Broken off before the new folder took its place.
    (tmp_path / "out" / "batch=2").rename(tmp_path / "out" / "_compact=2")
    ingest.compact(spark, str(tmp_path / "out"), 99)
    assert ids() == want and folders() == ["batch=2", "batch=3"]
    put(spark, [(9, "a"), (9, "late")], "seq long, id string", tmp_path / "in")
    go()
    assert ids() == sorted([*want, "late"])


def test_parts_of_requests_of_a_table(spark):
    """Early parts, late ones, repeats and no answer at all; nothing of it goes through a state store."""
    base = spark.createDataFrame([("a", 1, ["x", "y"]), ("b", 1, []), ("c", 5, ["x"]), ("d", 1, ["x", "y"]), ("f", 3, ["x"])], "base_id string, at long, file_paths array<string>").selectExpr("base_id", STAMP, "file_paths")
    rows = [("a", 1, "y", "1"), ("a", 0, "x", "2"), ("a", 2, "z", "3"), ("c", 2, "p", "4"), ("c", 3, "q", "5"), ("c", 5, "r", "6"), ("d", 2, "x", "7"), ("d", 1, "x", "8"), ("d", 40, "y", "9"), ("e", 7, "x", "0"), ("f", 3, "x", "1"), ("f", 4, "y", "2")]
    parts = spark.createDataFrame(rows, "base_id string, at long, part string, payload string").selectExpr("base_id", STAMP, "part", "payload")
    done = state.gathered(base, parts)
    found = sorted((r.base_id, r.part, r.payload, r.why, r.at) for r in done.selectExpr("*", "unix_millis(ts) - 1704067200000 at").collect())
    assert found == [
        ("a", "x", "2", "complete", 1000), ("a", "y", "1", "complete", 1000), ("b", None, None, "empty", 1000), ("c", "p", "4", "complete", 5000), ("c", "q", "5", "complete", 5000),
        ("d", "x", "8", "timeout", 31000), ("e", "x", "0", "timeout", 37000), ("f", "x", "1", "complete", 3000)]
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "TransformWithState" not in plan


def test_chunks_in_turn_need_no_store(spark):
    """Of a batch only what must wait is written into the state store."""

    class Store(dict):
        calls = 0

        def exists(self):
            return bool(self)

        def containsKey(self, key):
            self.calls += 1
            return key in self

        def getValue(self, key):
            return self[key]

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

        def removeKey(self, key):
            del self[key]

    class Value:
        kept = None

        def get(self):
            return self.kept

        def update(self, value):
            self.kept = value

    data = b"".join(framed(f) for f in FRAMES)
    cuts = [(i // 7, data[i : i + 7]) for i in range(0, len(data), 7)]
    reader = state.FrameReader()
    reader.open, reader.waiting = Value(), Store()
    take = lambda rows: [b for out in reader.handleInputRows(("a",), iter([pd.DataFrame(rows, columns=["seq", "chunk"])]), None) for b in out["body"]]
    first = take(cuts[19::-1] + cuts[25:27])
    assert reader.waiting.calls == 2 and sorted(reader.waiting) == [(25,), (26,)]
    rest = take([(25, b"again")] + cuts[20:25] + cuts[27:])
    assert not reader.waiting and [json.loads(b) for b in first + rest] == FRAMES


def test_symbols_of_a_table_need_no_store(spark):
    """Answers in the last millisecond and too late, requests asked again, refreshes and older generations; symbols end on their own, in one task too."""
    rows = [
        ("a", 1.001, "asked", "r", None, None, 0), ("a", 31.0019, "prepared", "r", '[{"name":"x"}]', None, 0), ("a", 61.5, "calls", "r/calls", None, None, 0),
        ("b", 0, "asked", "r", None, None, 0), ("b", 10, "asked", "r", None, None, 0), ("b", 35, "prepared", "r", "[]", None, 0), ("b", 36, "asked", "q", None, None, 0),
        ("c", 0, "asked", "r", None, None, 0), ("c", 1, "asked", "s", None, None, 2), ("c", 2, "prepared", "r", "[]", None, 2), ("c", 3, "error", "s", None, "old", 1), ("c", 4, "refresh", None, None, None, 2), ("c", 5, "prepared", "s", "[]", None, 2)]
    ts = "timestamp_micros(1704067200000000 + int(round(at * 10000)) * 100L) ts"
    table = spark.createDataFrame([(s, float(t), *r) for s, t, *r in rows], "symbol_id string, at double, kind string, request_id string, items string, message string, generation long")
    turns = state.symbol_states(table.selectExpr("symbol_id", ts, "kind", "request_id", "items", "message", "generation").coalesce(1))
    found = sorted((r.symbol_id, r.at, r.state, r.reason, r.send, r.request_id) for r in turns.selectExpr("*", "unix_micros(ts) - 1704067200000000 at").collect())
    late = ("Failed", state.TIMED_OUT, None)
    assert found == [
        ("a", 1001000, "Loading", None, "prepare", "r"), ("a", 31001900, "Loading", None, "incoming", "r/calls"), ("a", 61001000, *late, "r/calls"),
        ("b", 0, "Loading", None, "prepare", "r"), ("b", 10000000, "Loading", None, "prepare", "r"), ("b", 35000000, "Loaded", None, None, "r"),
        ("b", 36000000, "Loading", None, "prepare", "q"), ("b", 66000000, *late, "q"),
        ("c", 0, "Loading", None, "prepare", "r"), ("c", 1000000, "Loading", None, "prepare", "s"), ("c", 1000000, "NotLoaded", None, None, None), ("c", 4000000, "NotLoaded", None, None, None)]
    assert "TransformWithState" not in turns._jdf.queryExecution().executedPlan().toString()
