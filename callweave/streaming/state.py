"""Stateful streams: frames put together from chunks, requests in parts, and what is loaded of a symbol.

Each is a processor with state for a key, kept in the session's RocksDB state store, which `use_state`
names; it goes on from its checkpoint after a restart. All of them run over a table too, as one batch, of which frames alone use the store.

A processor takes the rows of a batch in the order that they have by their own columns. Rows for a key that is done with are ignored; what is kept of them ends by event time.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds that a request is waited for, and what is said then.
TIMEOUT_MS, TIMED_OUT = 30_000, "Request timed out"
CONTENT_LENGTH = b"content-length:"


def use_state(spark: SparkSession) -> None:
    """Names the state store that processors need, unless the session has one other than Spark's default, and starts what coordinates stores."""
    spark.streams.active  # noqa: B018  a batch finds its stores by what streams have started
    key = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(key, "HDFSBacked"):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def whole_frames(data: bytes) -> tuple[list[bytes], bytes]:
    """(bodies of whole frames, what is left). Header lines end a body's header when a blank line follows; lines before a length, and lengths that are no numbers, are passed over."""
    out, at = [], 0
    while True:
        here, length = at, None
        while (end := data.find(b"\n", here)) >= 0:
            line = data[here:end].strip()
            here = end + 1
            if line[: len(CONTENT_LENGTH)].lower() == CONTENT_LENGTH:
                number = line[len(CONTENT_LENGTH) :].strip()
                length = int(number) if number.isdigit() else None
            elif not line and length is not None:
                break
            elif length is None:
                at = here  # nothing of it is needed again
        else:
            return out, data[at:]
        if len(data) < here + length:
            return out, data[at:]
        out.append(data[here : here + length])
        at = here + length


class FrameReader(StatefulProcessor):
    """(seq, chunk) of a stream -> (at, body). Chunks are taken by seq, from 0 on; one that comes before its turn waits, one that comes again is ignored."""

    SCHEMA = "stream_id string, at long, body string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "next long, at long, rest binary")
        self.waiting = handle.getMapState("waiting", "seq long", "chunk binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, at, rest = self.open.get() or (0, 0, b"")
        come = {}
        for pdf in rows:
            for seq, chunk in zip(pdf["seq"].tolist(), pdf["chunk"]):
                if seq >= now:
                    come.setdefault(seq, chunk)
        # Of a batch the store gets only what must wait; what waits already goes before what comes again.
        waits = self.waiting.exists()
        found, data = [], [bytes(rest)]
        while True:
            if waits and self.waiting.containsKey((now,)):
                data.append(bytes(self.waiting.getValue((now,))[0]))
                self.waiting.removeKey((now,))
                come.pop(now, None)
            elif now in come:
                data.append(bytes(come.pop(now) or b""))
            else:
                break
            now += 1
        for seq, chunk in come.items():
            if not (waits and self.waiting.containsKey((seq,))):
                self.waiting.updateValue((seq,), (bytes(chunk or b""),))
        bodies, rest = whole_frames(b"".join(data))
        for body in bodies:
            found.append((key[0], at, body.decode("utf-8", "replace")))
            at += 1
        self.open.update((now, at, rest))
        yield pd.DataFrame(found, columns=["stream_id", "at", "body"])

    def close(self) -> None:
        pass


def frames(chunks: DataFrame) -> DataFrame:
    """chunks(stream_id string, seq, chunk binary) -> (stream_id, at, body): frames that are cut anywhere, also inside a header or a letter."""
    use_state(chunks.sparkSession)
    keyed = chunks.select("stream_id", F.col("seq").cast("long").alias("seq"), F.col("chunk").cast("binary").alias("chunk")).groupBy("stream_id")
    return keyed.transformWithStateInPandas(FrameReader(), FrameReader.SCHEMA, "Append", "None")


class PartGatherer(StatefulProcessor):
    """(part, expected, payload, ts) of a base request -> its parts, once all have come, time is over, or at once if it expects none.

    A row without a part is the base's own answer and says how many are expected; parts may come before it.
    The first row of a part counts.
    """

    SCHEMA = "base_id string, part string, payload string, why string, ts timestamp"

    def __init__(self, timeout_ms: int = TIMEOUT_MS):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "part string", "payload string")
        self.base = handle.getValueState("base", "expected int, done boolean, until long")

    def ended(self, key, why: str, ms: int) -> pd.DataFrame:
        """All parts, or one row without a part if there are none; the key stays done."""
        found = sorted((k[0], v[0]) for k, v in self.parts.iterator())
        self.parts.clear()
        expected, _, until = self.base.get()
        self.base.update((expected, True, until))
        return pd.DataFrame([(key[0], p, v, why, pd.Timestamp(ms, unit="ms")) for p, v in found or [(None, None)]], columns=["base_id", "part", "payload", "why", "ts"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(rows).sort_values(["ts", "part"], na_position="first")
        times = [int(t.timestamp() * 1000) for t in every["ts"]]
        expected, done, until = self.base.get() or (None, False, None)
        if done:
            return
        if until is None:
            until = times[0] + self.timeout_ms
            self.handle.registerTimer(until)
        for ms, part, n, payload in zip(times, every["part"], every["expected"], every["payload"]):
            if ms > until:
                break
            if not isinstance(part, str):
                expected = int(n) if expected is None and n == n and n is not None else expected
            elif not self.parts.containsKey((part,)):
                self.parts.updateValue((part,), (payload,))
            if expected is not None and sum(1 for _ in self.parts.keys()) >= expected:
                self.base.update((expected, False, until))
                yield self.ended(key, "complete" if expected else "empty", ms)
                return
        self.base.update((expected, False, until))
        if times[-1] > until:
            yield self.ended(key, "timeout", until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if not self.base.get():
            return
        if self.base.get()[1]:
            self.base.clear()
            return
        yield self.ended(key, "timeout", now)
        # What comes late is ignored for as long again, then nothing is kept.
        self.handle.registerTimer(now + self.timeout_ms)

    def close(self) -> None:
        pass


def asked_parts(answers: DataFrame) -> DataFrame:
    """answers(base_id, ts, file_paths array) -> (base_id, part): a request for the symbols of each different file."""
    return answers.select("base_id", "ts", F.explode(F.array_distinct("file_paths")).alias("part"))


def gathered(answers: DataFrame, parts: DataFrame, late: str = "10 seconds", timeout_ms: int = TIMEOUT_MS) -> DataFrame:
    """answers(base_id, ts, file_paths array), parts(base_id, ts, part, payload) -> (base_id, part, payload, why, ts) of base requests that are done."""
    none = F.lit(None).cast("string")
    base = answers.select("base_id", "ts", none.alias("part"), F.size(F.array_distinct("file_paths")).alias("expected"), none.alias("payload"))
    rest = parts.select("base_id", "ts", "part", F.lit(None).cast("int").alias("expected"), "payload")
    rows = base.unionByName(rest)
    if not rows.isStreaming:
        return _gathered_table(rows, timeout_ms)
    use_state(answers.sparkSession)
    return rows.withWatermark("ts", late).groupBy("base_id").transformWithStateInPandas(PartGatherer(timeout_ms), PartGatherer.SCHEMA, "Append", "EventTime")


def _gathered_table(rows: DataFrame, timeout_ms: int) -> DataFrame:
    """What PartGatherer gives if all rows of a key are there: nothing has to be remembered, and one shuffle by base_id is enough. What is missing then won't come."""
    own = Window.partitionBy("base_id")
    timely = rows.withColumn("ms", F.unix_millis("ts")).withColumn("until", F.min("ms").over(own) + timeout_ms).filter("ms <= until")
    # A row for each part, its first, and one for the base's own answer.
    first = timely.groupBy("base_id", "until", "part").agg(
        F.min(F.when(F.col("part").isNotNull(), F.struct("ts", "payload"))).alias("got"), F.min(F.when(F.col("part").isNull() & F.col("expected").isNotNull(), F.struct("ts", "expected"))).alias("said"))
    turn = own.orderBy(F.col("part").isNull(), "got.ts", "part")
    known = first.select(
        "base_id", "until", "part", "got", F.row_number().over(turn).alias("place"), F.count("part").over(own).alias("n"),
        F.max("said").over(own).alias("said"))
    # Parts that came before it was said how many are expected; the base's answer comes before parts of its own instant.
    known = known.withColumn("expected", F.col("said.expected")).withColumn("early", F.count_if(F.col("got.ts") < F.col("said.ts")).over(own))
    complete = F.coalesce(F.col("n") >= F.col("expected"), F.lit(False))
    known = known.withColumn("take", F.when(complete, F.greatest("early", "expected")).otherwise(F.col("n")))
    last = F.max(F.when(F.col("place") == F.col("take"), F.unix_millis("got.ts"))).over(own)
    at = F.when(~complete, F.col("until")).when(F.col("early") >= F.col("expected"), F.unix_millis("said.ts")).otherwise(last)
    why = F.when(~complete, "timeout").when(F.col("expected") == 0, "empty").otherwise("complete")
    told = known.select("base_id", "part", F.col("got.payload").alias("payload"), why.alias("why"), F.timestamp_millis(at).alias("ts"), "place", "take")
    return told.filter("case when part is null then take = 0 else place <= take end").drop("place", "take")


class Pending(dict):
    """What is pending of a symbol, as a map state has it, where all rows of the symbol come in turn."""

    containsKey, getValue, updateValue, removeKey, iterator = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__, dict.items


#: The order of a symbol's rows of one instant and generation, and what a pending request waits for, by kind.
ORDER = {"refresh": 0, "asked": 1, "prepared": 2, "calls": 3, "error": 4}
STEPS = {"prepared": "prepare", "calls": "calls"}


class SymbolTurns:
    """The rows of a symbol in turn -> its states, as rows without the symbol whose ts are microseconds.

    asked: a request begins, and the symbol is Loading. prepared: its answer has items (JSON); the first is
    asked on under the request's number and `/calls`, and without any the symbol is Loaded. calls: an answer
    that loads it. error: it has Failed. refresh: nothing is pending, nothing is loaded. An answer to what
    isn't pending is ignored, and so is a row of an older generation; the first of a newer one is a refresh.
    """

    def __init__(self, pending, follow_up: str, timeout_ms: int, state: str = "NotLoaded", generation: int = 0):
        self.pending, self.follow_up, self.timeout_ms, self.state, self.generation = pending, follow_up, timeout_ms, state, generation
        self.ends = [(v[1], k[0] is None, k) for k, v in pending.iterator()]
        heapq.heapify(self.ends)

    def turn(self, to: str, us: int, reason=None, send=None, request=None, item=None) -> tuple:
        self.state = to
        return us, to, reason, send, request, item

    def expire(self, before: float) -> Iterator[tuple]:
        """What was pending until before this millisecond has failed."""
        while self.ends and self.ends[0][0] < before:
            until, _, key = heapq.heappop(self.ends)
            # It may have its answer by now, or be asked again.
            if self.pending.containsKey(key) and self.pending.getValue(key)[1] == until:
                self.pending.removeKey(key)
                yield self.turn("Failed", until * 1000, reason=TIMED_OUT, request=key[0])

    def wait(self, request_id: str, step: str, at: int) -> None:
        self.pending.updateValue((request_id,), (step, at + self.timeout_ms))
        heapq.heappush(self.ends, (at + self.timeout_ms, request_id is None, (request_id,)))

    def take(self, us: int, kind: str, request_id: str, items: str | None, message: str | None, own: int) -> Iterator[tuple]:
        at = us // 1000
        yield from self.expire(at)
        if own < self.generation:
            return
        if own > self.generation or kind == "refresh":
            self.pending.clear()
            self.ends.clear()
            self.generation = own
            yield self.turn("NotLoaded", us)
            if kind == "refresh":
                return
        if kind == "asked":
            self.wait(request_id, "prepare", at)
            yield self.turn("Loading", us, send="prepare", request=request_id)
            return
        if not self.pending.containsKey((request_id,)):
            return
        if kind != "error" and self.pending.getValue((request_id,))[0] != STEPS.get(kind):
            return
        self.pending.removeKey((request_id,))
        if kind == "error":
            yield self.turn("Failed", us, reason=message, request=request_id)
            return
        asked_on = json.loads(items) if kind == "prepared" and isinstance(items, str) else []
        if not asked_on:
            yield self.turn("Loaded", us, request=request_id)
            return
        next_id = f"{request_id}/calls"
        self.wait(next_id, "calls", at)
        yield self.turn("Loading", us, send=self.follow_up, request=next_id, item=json.dumps(asked_on[0], ensure_ascii=False, separators=(",", ":")))


class SymbolLoader(StatefulProcessor):
    """(ts, kind, request_id, items, message, generation) of a symbol -> its states and the requests that follow, as SymbolTurns has them."""

    COLUMNS = ["symbol_id", "ts", "state", "reason", "send", "request_id", "item"]
    SCHEMA = "symbol_id string, ts timestamp, state string, reason string, send string, request_id string, item string"

    def __init__(self, outgoing: bool = False, timeout_ms: int = TIMEOUT_MS):
        self.follow_up, self.timeout_ms = "outgoing" if outgoing else "incoming", timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "request_id string", "step string, until long")
        self.state = handle.getValueState("state", "state string, generation long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(rows)
        every = every.assign(_order=every["kind"].map(ORDER)).sort_values(["ts", "generation", "_order", "request_id"])
        turns = SymbolTurns(self.pending, self.follow_up, self.timeout_ms, *(self.state.get() or ("NotLoaded", 0)))
        out = []
        for r in every.itertuples():
            for t in turns.take(r.ts.value // 1000, r.kind, r.request_id, r.items, r.message, int(r.generation)):
                if t[3]:
                    self.handle.registerTimer(t[0] // 1000 + self.timeout_ms)
                out.append((key[0], pd.Timestamp(t[0], unit="us"), *t[1:]))
        self.state.update((turns.state, turns.generation))
        yield self.table(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        over = [k[0] for k, v in self.pending.iterator() if v[1] <= now]
        for request_id in over:
            self.pending.removeKey((request_id,))
        if over:
            self.state.update(("Failed", (self.state.get() or ("", 0))[1]))
        yield self.table([(key[0], pd.Timestamp(now, unit="ms"), "Failed", TIMED_OUT, None, r, None) for r in sorted(over)])

    def table(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.COLUMNS)

    def close(self) -> None:
        pass


def symbol_states(events: DataFrame, outgoing: bool = False, late: str = "10 seconds", timeout_ms: int = TIMEOUT_MS) -> DataFrame:
    """events(symbol_id, ts, kind, request_id, items, message, generation) -> each turn of a symbol's state, and what to send with it."""
    rows = events.select("symbol_id", "ts", "kind", "request_id", "items", "message", F.coalesce("generation", F.lit(0)).cast("long").alias("generation"))
    if not rows.isStreaming:
        return _symbol_table(rows, outgoing, timeout_ms)
    use_state(events.sparkSession)
    return rows.withWatermark("ts", late).groupBy("symbol_id").transformWithStateInPandas(SymbolLoader(outgoing, timeout_ms), SymbolLoader.SCHEMA, "Append", "EventTime")


def _symbol_table(rows: DataFrame, outgoing: bool, timeout_ms: int) -> DataFrame:
    """What SymbolLoader gives if all rows of a key are there, and what is pending then has failed: a task goes once through its
    symbols, sorted by Spark, and remembers of one symbol at a time what is pending; nothing goes through a state store."""
    follow_up = "outgoing" if outgoing else "incoming"
    keys = ["symbol_id", "us", "generation", "_order", "request_id"]
    order = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in ORDER.items()])
    flat = rows.select("symbol_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "kind", "request_id", "items", "message", "generation", order.alias("_order"))
    # As pandas sorts: nulls last.
    turned = flat.repartition("symbol_id").sortWithinPartitions("symbol_id", *[F.col(c).asc_nulls_last() for c in keys[1:]])

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, turns = None, None

        def table(out: list) -> pd.DataFrame:
            return pd.DataFrame(out, columns=["symbol_id", "us", *SymbolLoader.COLUMNS[2:]]).astype({"us": "int64"})

        for pdf in batches:
            out = []
            for own, *row in zip(*[pdf[c].tolist() for c in ("symbol_id", "us", "kind", "request_id", "items", "message", "generation")]):
                if turns is None or own != symbol:
                    if turns is not None:
                        out += [(symbol, *t) for t in turns.expire(float("inf"))]
                    symbol, turns = own, SymbolTurns(Pending(), follow_up, timeout_ms)
                out += [(symbol, *t) for t in turns.take(*row)]
            yield table(out)
        if turns is not None:
            yield table([(symbol, *t) for t in turns.expire(float("inf"))])

    found = turned.mapInPandas(go, "symbol_id string, us long, state string, reason string, send string, request_id string, item string")
    return found.select("symbol_id", F.timestamp_micros("us").alias("ts"), *SymbolLoader.COLUMNS[2:])
