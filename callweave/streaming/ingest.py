"""Streams of messages: functions and calls that enter a graph, requests and their answers, states of symbols.

State is bounded by watermarks. What a batch finds goes to tables by foreachBatch, once for each batch number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..graph import CallGraph, distinct_calls, first_wins
from ..sources import messages

# How long a request, a server's start and the first symbols are waited for.
TIMEOUT, START, SYMBOLS = "30 seconds", "10 seconds", "2 seconds"
#: Parts of a growing table by its keys; a batch reads those that its own keys belong to.
BUCKETS = 64


def new_functions(stream: DataFrame, late: str = "1 minute") -> DataFrame:
    """Functions(ts, id, ...) of a stream, each id once as long as its repeats come within the delay."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def grow(stream: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Writes rows whose keys are new to the table at `path`, the first of each; without keys, calls by their identity.

    Each batch is a folder named by its number, with a folder for each part of the keys: run again it is
    written over, so that rows are never doubled.
    """

    def add(batch: DataFrame, number: int) -> None:
        own = f"{path}/batch={number}"
        spark = batch.sparkSession
        rows = first_wins(batch, keys) if keys else distinct_calls(batch)
        place = F.struct(*(keys or ["caller", "callee", *[F.col(f"call_location.{c}").alias(c) for c in ("file_path", "line", "column")]]))
        rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(place), F.lit(BUCKETS)).cast("int"))
        if number > 0:
            touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # BUCKETS numbers at most
            known = spark.read.option("mergeSchema", False).schema(batch.schema.add("batch", "long").add("_bucket", "integer")).parquet(path)
            known = known.filter((F.col("batch") < number) & F.col("_bucket").isin(*touched))
            rows = rows.withColumn("_at", place).join(known.select(place.alias("_at")), "_at", "left_anti").drop("_at")
        rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(own)

    out = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True})).start()


def compact(spark: SparkSession, path: str, upto: int) -> None:
    """Puts the batches up to a number of a table that `grow` writes into one, a file for each part of the keys, so that a batch lists fewer folders.

    Nothing may read or write the table meanwhile, and the last batch stays as it is, as it may be run again.
    Where this was broken off, it is ended when it is called again.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = lambda name: jvm.org.apache.hadoop.fs.Path(root, name)

    def swap(number: int) -> None:
        """What was written takes the place of the batches that it holds."""
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            if name.startswith("batch=") and int(name.removeprefix("batch=")) <= number:
                fs.delete(s.getPath(), True)
        fs.rename(at(f"_compact={number}"), at(f"batch={number}"))

    names = [s.getPath().getName() for s in fs.listStatus(root)]
    for name in names:
        if name.startswith("_compact="):
            number = int(name.removeprefix("_compact="))
            swap(number) if fs.exists(at(f"{name}/_SUCCESS")) else fs.delete(at(name), True)
    batches = sorted(int(s.getPath().getName().removeprefix("batch=")) for s in fs.listStatus(root) if s.getPath().getName().startswith("batch="))
    old = [b for b in batches[:-1] if b <= upto]
    if len(old) < 2:
        return
    rows = spark.read.parquet(path).filter(F.col("batch") <= old[-1]).drop("batch")
    rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/_compact={old[-1]}")
    swap(old[-1])


def matched(requests: DataFrame, responses: DataFrame, late: str = "10 seconds", timeout: str = TIMEOUT) -> DataFrame:
    """requests(request_id, ts, ...), responses(request_id, ts, ...) -> each request with its first answer within the timeout, as response_ts and what else it has; later ones are ignored."""
    return _joined(requests, responses, late, timeout, "inner")


def outcomes(requests: DataFrame, responses: DataFrame, late: str = "10 seconds", timeout: str = TIMEOUT) -> DataFrame:
    """Each request as answered or, once the watermark has passed its time, as failed: (request_id, symbol_id, state, reason, ts)."""
    j = _joined(requests, responses, late, timeout, "left_outer")
    done = F.col("response_ts").isNotNull()
    return j.select(
        "request_id", "symbol_id", F.when(done, "Loaded").otherwise("Failed").alias("state"),
        F.when(~done, "Request timed out").alias("reason"), F.coalesce("response_ts", F.col("ts") + F.expr(f"interval {timeout}")).alias("ts"))


def _joined(requests: DataFrame, responses: DataFrame, late: str, timeout: str, how: str) -> DataFrame:
    right = responses.select(F.col("request_id").alias("_id"), F.col("ts").alias("response_ts"), *[c for c in responses.columns if c not in ("request_id", "ts")])
    if requests.isStreaming:
        requests, right = requests.withWatermark("ts", late), right.withWatermark("response_ts", late)
    in_time = (F.col("request_id") == F.col("_id")) & (F.col("response_ts") >= F.col("ts")) & (F.col("response_ts") <= F.col("ts") + F.expr(f"interval {timeout}"))
    joined = requests.join(right, in_time, how).drop("_id")
    # A request is done with its first answer.
    rest = [c for c in right.columns if c not in ("_id", "response_ts")]
    first = joined.groupBy(*requests.columns).agg(F.min(F.struct("response_ts", *rest)).alias("_first"))
    return first.select(*requests.columns, "_first.response_ts", *[f"_first.{c}" for c in rest])


def loads(sessions: DataFrame) -> DataFrame:
    """sessions(session_id, started, initialized, asked, symbols: array of (ts, name)) -> session_id, phase, reason, loaded: symbols that came in time; a server that doesn't start in time has failed."""
    up = F.col("initialized") <= F.col("started") + F.expr(f"interval {START}")
    in_time = F.size(F.filter(F.coalesce("symbols", F.array()), lambda s: s["ts"] <= F.col("asked") + F.expr(f"interval {SYMBOLS}")))
    failed = ~F.coalesce(up, F.lit(False))
    return sessions.select(
        "session_id", F.when(failed, "Failed").otherwise("Completed").alias("phase"), F.when(failed, "Initialization timed out").alias("reason"),
        F.when(failed, 0).otherwise(F.coalesce(in_time, F.lit(0))).alias("loaded"))


def since_refresh(events: DataFrame, refreshes: DataFrame) -> DataFrame:
    """events(ts, ...) after the last refresh(ts): what was loading or pending before is forgotten."""
    last = refreshes.agg(F.max("ts").alias("_last"))
    return events.join(F.broadcast(last), F.col("_last").isNull() | (F.col("ts") > F.col("_last"))).drop("_last")  # one row


def states(events: DataFrame) -> DataFrame:
    """events(symbol_id, ts, state) -> the last state of each symbol; one that isn't there is NotLoaded."""
    return events.groupBy("symbol_id").agg(F.max_by("state", F.struct("ts", "state")).alias("state"))


def put_answers(stream: DataFrame, pending: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes what a stream of JSON messages(value) answers to pending(id, method, function_id, file_path) requests into the graph's tables at `path`.

    Callees, callers and workspace symbols are new functions and calls; references replace those that their
    function had, also by none. Every batch has a folder of its number in each table and is written over
    when it is run again, so that nothing counts twice; `graph_at` puts the tables together.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        opened = messages.envelopes(batch.select("value")).filter("m is not null")
        asked = pending.withColumnRenamed("id", "_id").dropDuplicates(["_id"])
        asked = asked.select(F.col("_id").alias("id"), "method", "function_id", "file_path")
        of = lambda *methods: messages.answers(opened, asked, methods)
        functions, calls = [], []
        for method, outgoing in ((messages.OUTGOING, True), (messages.INCOMING, False)):
            sites = messages.call_sites(of(method), outgoing, asked if outgoing else None)
            new, sent = messages.found_calls(sites, asked, outgoing)
            functions.append(new)
            calls.append(sent)
        functions.append(messages.loaded_functions(of("workspace/symbol")))
        known = of(*messages.REFERENCES)
        refreshed = known.filter("error is null").join(asked.select("id", "function_id"), "id").select("function_id", F.col("id").cast("long").alias("seq"))
        places = messages.locations(known).join(asked.select("id", "function_id"), "id")
        places = places.select(F.col("id").cast("long").alias("seq"), "at", "function_id", "location")
        tables = {"functions": functions[0].unionByName(functions[1]).unionByName(functions[2]), "calls": calls[0].unionByName(calls[1]), "references": places, "refreshed": refreshed}
        try:
            for name, rows in tables.items():
                rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        finally:
            batch.unpersist()

    out = stream.select("value").writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True})).start()


def graph_at(spark: SparkSession, path: str) -> CallGraph:
    """The graph that `put_answers` has written so far: functions as they came first, calls once, references of each function's last answer."""
    read = lambda name, kind: spark.read.schema(f"{kind}, batch long").parquet(f"{path}/{name}")
    functions = read("functions", messages.FUNCTION_ROW).withColumn("seq", F.struct("batch", "seq"))
    functions = first_wins(functions.drop("batch"), ["id"]).withColumn("seq", F.col("seq.seq"))
    calls = read("calls", schema.CALLS).drop("batch")
    last = read("refreshed", "function_id string, seq long").groupBy("function_id").agg(F.max(F.struct("batch", "seq")).alias("last"))
    places = read("references", f"seq long, at int, function_id string, location {schema.LOCATION}")
    current = places.join(last, "function_id").filter(F.struct("batch", "seq") == F.col("last"))
    references = current.select(F.col("at").cast("long").alias("seq"), "function_id", "location", F.lit(None).cast(schema.SYMBOL).alias("referencing_symbol"))
    return CallGraph.empty(spark).add_functions(functions).add_calls(calls).add_references(references)


def latest_references(refreshes: DataFrame) -> DataFrame:
    """refreshes(function_id, ts, ...): the rows of each function's last refresh, which replaces those before."""
    last = refreshes.groupBy("function_id").agg(F.max("ts").alias("ts"))
    return refreshes.join(last, ["function_id", "ts"])


def complete_groups(parts: DataFrame, expected: DataFrame) -> DataFrame:
    """parts(base_id, part_id), expected(base_id, n): base requests all of whose parts have come; one that expects none is complete."""
    come = parts.groupBy("base_id").agg(F.countDistinct("part_id").alias("come"))
    return expected.join(come, "base_id", "left").filter(F.coalesce("come", F.lit(0)) >= F.col("n")).select("base_id")
