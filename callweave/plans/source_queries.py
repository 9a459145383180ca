"""Queries of scalar functions, containment, messages and request streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import containment
from ..sources import files, messages
from ..streaming import ingest, state
from .derived import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("SELECT p_partkey, replace(p_name, ' ', '_') AS name FROM part")
def signature_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    signature = F.concat("p_type", F.lit(" *"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("("), F.col("p_size").cast("string"), F.lit(")"))
    return part.select("p_partkey", text.name_of_signature(signature).alias("name"))


@query("SELECT page_id, regexp_extract(url, '[^/]*$') AS base FROM pages")
def basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.basename(F.col("url")).alias("base"))


@query("SELECT p_partkey, p_brand || '::' || p_name AS qualified, CASE WHEN length(p_brand || '::' || p_name) > 22 THEN left(p_brand || '::' || p_name, 21) || '…' ELSE p_brand || '::' || p_name END AS label FROM part")
def qualified_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select("p_partkey", ids.qualified_name(F.col("p_brand"), F.col("p_name")).alias("qualified"))
    return named.select("p_partkey", "qualified", text.node_label(F.col("qualified")).alias("label"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""SELECT e.event_id AS id, 'user_' || e.user_id AS file_path, ((e.props->>'$.k')::INT + 1)::INT AS line, 5::INT AS "column", 7::INT AS length FROM events e""")
def reference_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to reference requests, one made of each event, parsed."""
    e = table(spark, sf_dir, "events")
    line = F.from_json("props", "k int")["k"]
    place = lambda c: F.struct(line.alias("line"), F.lit(c).alias("character"))
    result = F.array(F.struct(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("uri"), F.struct(place(4).alias("start"), place(11).alias("end")).alias("range")))
    sent = e.select(F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.col("event_id").alias("id"), result.alias("result"))).alias("value"))
    pending = e.select(F.col("event_id").alias("id"), F.lit(messages.REFERENCES[0]).alias("method"))
    found = messages.locations(messages.answers(messages.envelopes(sent), pending, messages.REFERENCES))
    return found.select("id", "location.*")


@query("SELECT page_id, CASE regexp_extract(url, '\\.([^.]+)$', 1) WHEN 'c' THEN 'c' ELSE 'plaintext' END AS language FROM pages")
def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ids.language_of(F.col("url")).alias("language"))


@query("SELECT count(*)::BIGINT AS loaded, 0::BIGINT AS failed FROM pages")
def preload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.preload_counts(table(spark, sf_dir, "pages").select(F.col("url").alias("uri"), F.col("html").isNotNull().alias("ok")))


@query("SELECT page_id, url FROM pages p WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT regexp_extract(p_name, '^.(..)', 1) AS f FROM part) x WHERE contains(p.url, f) OR contains(f, p.url))")
def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose address has the second and third letter of a part's name in it."""
    names = table(spark, sf_dir, "part").select(F.substring("p_name", 2, 2).alias("f")).distinct()
    return containment.project_paths(table(spark, sf_dir, "pages").select("page_id", "url"), "url", names)


SHIPPED = """WITH o AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders),
l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('day', DATE '1995-01-01', l_shipdate::DATE) AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS k FROM lineitem),
s AS (SELECT o_custkey AS file, [k] AS path, d AS a, d + 120 AS b, d AS oa, d + 120 AS ob, 'order ' || o_orderkey AS symbol FROM o
  UNION ALL SELECT o_custkey, [o.k, l.k], l.d, l.d + 5, o.d, o.d + 120, 'line ' || o_orderkey || '/' || l.k FROM l JOIN o ON l_orderkey = o_orderkey),
p AS (SELECT l_orderkey * 1000 + l.k AS pos_id, o_custkey AS file, l.d AS pd FROM l JOIN o ON l_orderkey = o_orderkey),
h AS (SELECT pos_id, symbol, row_number() OVER (PARTITION BY pos_id ORDER BY list_append(path, 2147483647)) AS r FROM p JOIN s ON p.file = s.file AND pd BETWEEN a AND b AND pd BETWEEN oa AND ob)"""


def _shipped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Days lines were shipped, in the orders of the same customer: an order runs for 120 days, a line for five."""
    day = lambda c: F.date_diff(F.to_date(c), F.lit("1995-01-01").cast("date"))
    point = lambda d: F.struct(d.alias("line"), F.lit(0).alias("character"))
    span = lambda d, n: F.struct(point(d).alias("start"), point(d + n).alias("end"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", day("o_orderdate").alias("od"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("ok"))
    turn = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", day("l_shipdate").alias("d"), (F.row_number().over(turn) - 1).alias("k"))
    both = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    order_range, file = span(F.col("od"), 120), F.col("o_custkey").cast("string").alias("file")
    none = F.array().cast(f"array<{messages.RANGE}>")
    key = F.col("o_orderkey").cast("string")
    symbols = o.select(file, F.array("ok").alias("path"), order_range.alias("range"), none.alias("around"), F.concat(F.lit("order "), key).alias("symbol")).unionByName(
        both.select(file, F.array("ok", "k").alias("path"), span(F.col("d"), 5).alias("range"), F.array(order_range).alias("around"), F.concat(F.lit("line "), key, F.lit("/"), F.col("k").cast("string")).alias("symbol")))
    positions = both.select((F.col("l_orderkey") * 1000 + F.col("k")).alias("pos_id"), file, point(F.col("d")).alias("at"))
    return positions, symbols


@query(f"{SHIPPED} SELECT p.pos_id::BIGINT AS pos_id, symbol FROM p LEFT JOIN (SELECT * FROM h WHERE r = 1) h USING (pos_id)")
def containing_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.containing_symbol(*_shipped(spark, sf_dir))


@query(f"{SHIPPED} SELECT p.pos_id::BIGINT AS pos_id, p.file::VARCHAR AS file, pd::INT AS line, symbol FROM p LEFT JOIN (SELECT * FROM h WHERE r = 1) h USING (pos_id)")
def enhanced_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions, symbols = _shipped(spark, sf_dir)
    return containment.enhanced_references(positions, symbols).select("pos_id", "file", F.col("at.line").alias("line"), "symbol")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS k FROM lineitem)
SELECT o_orderkey AS id, '0' AS path, 'order ' || o_orderkey AS name, 'order ' || o_orderkey AS qualified_name, 5::INT AS kind, NULL AS container_name, 0::INT AS line FROM orders
UNION ALL SELECT l_orderkey, '0/' || k, 'line ' || l_partkey, 'order ' || l_orderkey || '::line ' || l_partkey, 12, 'order ' || l_orderkey, l_linenumber::INT FROM l JOIN orders ON l_orderkey = o_orderkey""")
def document_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents with one symbol, their lines as symbols in it, parsed level by level."""
    point = lambda line, c: F.struct(line.cast("int").alias("line"), F.lit(c).alias("character"))
    span = lambda line: F.struct(point(line, 0).alias("start"), point(line, 9).alias("end"))

    def symbol(name, kind: int, line) -> list:
        return [name.alias("name"), F.lit(kind).alias("kind"), span(line).alias("range"), span(line).alias("selectionRange")]

    line = F.struct(*symbol(F.concat(F.lit("line "), F.col("l_partkey").cast("string")), 12, F.col("l_linenumber")))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("symbol")))).alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    inside = F.transform("lines", lambda x: x["symbol"]).alias("children")
    result = F.array(F.struct(*symbol(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), 5, F.lit(0)), inside))
    found = messages.document_symbols(orders.select(F.col("o_orderkey").alias("id"), F.to_json(result).alias("result"), F.lit(None).cast("string").alias("error")))
    return found.select("id", F.array_join("path", "/").alias("path"), "name", "qualified_name", "kind", "container_name", "location.line")


@query("""WITH x AS (SELECT l_orderkey AS id, l_partkey AS p, l_linenumber AS n, unnest(range(0, 1 + l_linenumber % 2)) AS r FROM lineitem)
SELECT id, 'part ' || p AS name, CASE p % 2 WHEN 0 THEN 'lib::part ' || p ELSE 'part ' || p END AS qualified_name, CASE p % 3 WHEN 0 THEN 'Method' ELSE 'Function' END AS kind,
'/src/part ' || p || '.c' AS file_path, (p + 1)::INT AS line, (n + r + 1)::INT AS call_line, 3::INT AS call_column, CASE r WHEN 0 THEN 4 ELSE -1 END::INT AS call_length FROM x""")
def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as answers with an outgoing call each, which stands in one place or two; a length of -1 for places that end on another line."""
    point = lambda line, c: F.struct(line.cast("int").alias("line"), F.lit(c).alias("character"))
    span = lambda a, b: F.struct(point(a, 2).alias("start"), point(b, 6).alias("end"))
    part, n = F.col("l_partkey"), F.col("l_linenumber")
    to = F.struct(
        F.concat(F.lit("part "), part.cast("string")).alias("name"), F.when(part % 3 == 0, 6).otherwise(12).alias("kind"), F.when(part % 2 == 0, "lib").otherwise("").alias("detail"),
        F.concat(F.lit("file:///src/part%20"), part.cast("string"), F.lit(".c")).alias("uri"), span(part, part).alias("range"), span(part, part).alias("selectionRange"))
    places = F.slice(F.array(span(n, n), span(n + 1, n + 2)), 1, (1 + n % 2).cast("int"))
    result = F.to_json(F.array(F.struct(to.alias("to"), places.alias("fromRanges"))))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), result.alias("result"), F.lit(None).cast("string").alias("error"))
    at, call = F.col("item.definition_location"), F.col("call_location")
    return messages.call_sites(rows, outgoing=True).select(
        "id", "item.name", "item.qualified_name", "item.kind", at["file_path"].alias("file_path"), at["line"].alias("line"),
        call["line"].alias("call_line"), call["column"].alias("call_column"), F.coalesce(call["length"], F.lit(-1)).alias("call_length"))


@query("""WITH x AS (SELECT event_id, user_id, event_type, (props->>'$.k')::INT AS k FROM events)
SELECT event_id, '/user ' || user_id AS file_path, (k + 1)::INT AS line, 4::INT AS "column", greatest(k - 1, 0)::INT AS asked, CASE k % 2 WHEN 0 THEN 'k' ELSE '' END || '::' || event_type AS detailed FROM x""")
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of events by URI and position, the line that a request for them has, and names with a detail."""
    k = F.from_json("props", "k int")["k"]
    uri = F.concat(F.lit("file:///user%20"), F.col("user_id").cast("string"))
    at = ids.location_of_position(uri, F.struct(k.alias("line"), F.lit(3).alias("character")))
    named = ids.detailed_name(F.when(k % 2 == 0, "k"), F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("event_id", at.alias("at"), ids.request_position(k).alias("asked"), named.alias("detailed"))
    return rows.select("event_id", "at.file_path", "at.line", "at.column", "asked", "detailed")


# Requests are views, answers the purchases of the same user.
ASKED = "q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), a AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase')"


@query(f"WITH {ASKED} SELECT event_id AS request_id, CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.user_id = q.user_id AND a.ts >= q.ts AND a.ts <= q.ts + INTERVAL 1 HOUR) THEN 'Loaded' ELSE 'Failed' END AS state FROM q")
def request_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views that a purchase of their user follows within an hour."""
    e = table(spark, sf_dir, "events")
    asked = e.filter("event_type = 'view'").select(F.col("user_id").alias("request_id"), "ts", F.col("event_id").alias("symbol_id"))
    got = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("request_id"), "ts")
    found = ingest.outcomes(asked, got, timeout="1 hour")
    return found.groupBy(F.col("symbol_id").alias("request_id")).agg(F.max("state").alias("state"))


@query("SELECT user_id AS symbol_id, arg_max(event_type, (ts, event_type)) AS state FROM events GROUP BY 1")
def symbol_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.states(table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol_id"), "ts", F.col("event_type").alias("state")))


@query("SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS at, props || '€' AS body FROM events")
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as a stream of frames, with one that is cut off at its end, read again."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", messages.framed(F.concat("props", F.lit("€"))).alias("frame"))
    streams = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "frame"))).alias("f"))
    cut = F.concat(F.array_join(F.transform("f", lambda x: x["frame"]), ""), F.lit("Content-Length: 9\r\n\r\n{}"))
    return messages.unframed(streams.select("user_id", cut.alias("value")))


@query("""SELECT event_id, '{"jsonrpc":"2.0","id":' || event_id || ',"method":"textDocument/hover","params":{"textDocument":{"uri":"user_' || user_id || '"},"position":{"line":' || (props->>'$.k') || ',"character":4}}}' AS request FROM events""")
def hover_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    uri = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    return e.select("event_id", messages.hover_request(F.col("event_id"), uri, F.from_json("props", "k int")["k"], F.lit(4)).alias("request"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN p_name || chr(10) || replace(p_name, ' ', '_') ELSE p_name END AS hover FROM part""")
def hover_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts in each form that a hover answer has."""
    part = table(spark, sf_dir, "part")
    code = F.concat(F.lit("int *"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("(void)"))
    marked = F.to_json(F.struct(F.lit("c").alias("language"), code.alias("value")))
    name = F.concat(F.lit('"'), F.col("p_name"), F.lit('"'))
    contents = (F.when(F.col("p_partkey") % 4 == 1, marked).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("["), name, F.lit(","), marked, F.lit("]")))
                .when(F.col("p_partkey") % 4 == 3, F.to_json(F.struct(F.lit("plaintext").alias("kind"), F.col("p_name").alias("value")))).otherwise(name))
    return part.select("p_partkey", text.hover_of(F.concat(F.lit('{"contents":'), contents, F.lit("}"))).alias("hover"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'Loaded' ELSE 'Loading' END AS state,
CASE WHEN s_suppkey % 3 > 0 THEN '{"jsonrpc":"2.0","id":' || s_suppkey || ',"method":"callHierarchy/incomingCalls","params":{"item":{"name":"' || s_name || '","kind":12}}}' END AS follow_up FROM supplier""")
def hierarchy_expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared hierarchies of none, one or two items: the first is asked on."""
    s = table(spark, sf_dir, "supplier")
    item = F.struct(F.col("s_name").alias("name"), F.lit(12).alias("kind"))
    other = F.struct(F.lit("other").alias("name"), F.lit(6).alias("kind"))
    result = F.slice(F.array(item, other), 1, (F.col("s_suppkey") % 3).cast("int"))
    return messages.expansions(s.select(F.col("s_suppkey").alias("id"), F.to_json(result).alias("result"), F.lit(None).cast("string").alias("error")))


@query("""SELECT event_id, 'LSP: ' || CASE event_id % 4 WHEN 0 THEN 'preloading documents… ' || user_id || '/' || event_id WHEN 1 THEN 'loading workspace symbols… ' || user_id
WHEN 2 THEN 'failed (' || event_type || ')' ELSE 'ready' END AS status FROM events""")
def load_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    phases = F.array(*[F.lit(p) for p in ("PreloadingDocuments", "LoadingWorkspaceSymbols", "Failed", "Completed")])
    phase = F.get(phases, (F.col("event_id") % 4).cast("int"))
    return e.select("event_id", text.phase_text(phase, F.col("user_id"), F.col("event_id"), F.col("event_type")).alias("status"))


@query(f"WITH {ASKED} SELECT q.event_id AS symbol_id, min(a.ts) AS response_ts FROM q JOIN a ON a.user_id = q.user_id AND a.ts >= q.ts AND a.ts <= q.ts + INTERVAL 1 HOUR GROUP BY 1")
def first_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first purchase within an hour of each view."""
    e = table(spark, sf_dir, "events")
    asked = e.filter("event_type = 'view'").select(F.col("user_id").alias("request_id"), "ts", F.col("event_id").alias("symbol_id"))
    got = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("request_id"), "ts")
    return ingest.matched(asked, got, timeout="1 hour").select("symbol_id", "response_ts")


@query("SELECT 'user ' || user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS at, props || '€' AS body FROM events")
def frames_of_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as a stream of frames, cut into chunks of 37 bytes, also inside headers and letters, and put together again."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", messages.framed(F.concat("props", F.lit("€"))).alias("frame"))
    streams = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "frame"))).alias("f"))
    data = F.encode(F.array_join(F.transform("f", lambda x: x["frame"]), ""), "UTF-8")
    whole = streams.select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("stream_id"), data.alias("data"))
    chunks = F.transform(F.sequence(F.lit(1), F.octet_length("data"), F.lit(37)), lambda at: F.substring("data", at, F.lit(37)))
    cut = whole.select("stream_id", F.posexplode(chunks).alias("seq", "chunk"))
    return state.frames(cut)


LOADING = """WITH a AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'view'), p AS (SELECT user_id, ts FROM events WHERE event_type = 'click'),
x AS (SELECT a.user_id, a.event_id, a.ts AS asked, (SELECT min(p.ts) FROM p WHERE p.user_id = a.user_id AND p.ts >= a.ts AND p.ts <= a.ts + INTERVAL 1 HOUR) AS got FROM a)"""


@query(f"""{LOADING} SELECT 'user ' || user_id AS symbol_id, 'r' || event_id AS request_id, CASE WHEN got IS NULL THEN 'Failed' WHEN event_id % 3 = 0 THEN 'Loaded' ELSE 'Failed' END AS state,
CASE WHEN got IS NULL OR event_id % 3 > 0 THEN 'Request timed out' END AS reason,
CASE WHEN got IS NULL THEN date_trunc('milliseconds', asked + INTERVAL 1 HOUR) WHEN event_id % 3 = 0 THEN got ELSE date_trunc('milliseconds', got + INTERVAL 1 HOUR) END AS ts FROM x""")
def symbol_loading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views ask for a user's calls, the first click within an hour prepares them, for two of three with an item that is asked on and never answered: how each request ends."""
    e = table(spark, sf_dir, "events")
    symbol = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    asked = e.filter("event_type = 'view'").select(F.col("user_id").alias("request_id"), "ts", F.col("event_id").alias("symbol_id"))
    got = ingest.matched(asked, e.filter("event_type = 'click'").select(F.col("user_id").alias("request_id"), "ts"), timeout="1 hour")
    of = F.concat(F.lit("r"), F.col("symbol_id").cast("string"))
    user = F.concat(F.lit("user "), F.col("request_id").cast("string"))
    items = F.when(F.col("symbol_id") % 3 == 0, "[]").otherwise('[{"name":"f"},{"name":"g"}]')
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    row = lambda who, ts, kind, request, what: [who.alias("symbol_id"), ts.alias("ts"), F.lit(kind).alias("kind"), request.alias("request_id"), what.alias("items"), none.alias("message"), zero.alias("generation")]
    own = F.concat(F.lit("r"), F.col("event_id").cast("string"))
    events = e.filter("event_type = 'view'").select(*row(symbol, F.col("ts"), "asked", own, none)).unionByName(got.select(*row(user, F.col("response_ts"), "prepared", of, items)))
    turns = state.symbol_states(events, timeout_ms=3_600_000)
    ended = turns.filter("state in ('Loaded', 'Failed')")
    return ended.select("symbol_id", F.regexp_replace("request_id", "/calls$", "").alias("request_id"), "state", "reason", "ts")


GATHERED = """WITH o AS (SELECT o_orderkey, o_orderdate::TIMESTAMP AS ts, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders),
p AS (SELECT l_orderkey, l_suppkey, min(l_shipdate::TIMESTAMP) AS ts FROM lineitem JOIN o ON o_orderkey = l_orderkey WHERE l_shipdate::TIMESTAMP >= o.ts AND l_shipdate::TIMESTAMP <= o.ts + INTERVAL 60 DAY GROUP BY ALL)"""


@query(f"""{GATHERED} SELECT 'order ' || o_orderkey AS base_id, count(l_suppkey)::BIGINT AS parts, CASE WHEN n = 0 THEN 'empty' WHEN count(l_suppkey) = n THEN 'complete' ELSE 'timeout' END AS why,
CASE WHEN n = 0 THEN o.ts WHEN count(l_suppkey) = n THEN max(p.ts) ELSE o.ts + INTERVAL 60 DAY END AS ts FROM o LEFT JOIN p ON l_orderkey = o_orderkey GROUP BY o_orderkey, n, o.ts""")
def reference_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders ask each of their suppliers for a part, which comes with the first line that it ships: when orders are complete, or given up after sixty days."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    base = lambda c: F.concat(F.lit("order "), F.col(c).cast("string")).alias("base_id")
    supplier = F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string"))
    paths = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(supplier).alias("file_paths"))
    answers = orders.join(paths, "o_orderkey", "left").select(base("o_orderkey"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.coalesce("file_paths", F.array().cast("array<string>")).alias("file_paths"))
    sent = lines.join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).filter("l_shipdate >= o_orderdate")
    parts = sent.select(base("l_orderkey"), F.col("l_shipdate").cast("timestamp").alias("ts"), supplier.alias("part"), F.col("l_partkey").cast("string").alias("payload"))
    done = state.gathered(answers, parts, timeout_ms=60 * 86_400_000)
    return done.groupBy("base_id", "why", "ts").agg(F.count("part").alias("parts"))


@query("""WITH t AS (SELECT p_partkey AS id, p_name AS n, p_size % 8 AS deep, p_partkey % 5 = 0 AS flat FROM part),
x AS (SELECT id, n, flat, deep, unnest(range(0, CASE WHEN flat THEN 1 ELSE deep + 1 END)) AS k FROM t)
SELECT id, array_to_string(list_transform(range(0, k + 1), lambda z: '0'), '/') AS path, n || k AS name, CASE WHEN k > 0 THEN n || (k - 1) || '::' || n || k ELSE n || k END AS qualified_name,
CASE WHEN flat THEN 'box' END AS detail, CASE WHEN k > 0 THEN n || (k - 1) END AS container_name, k::INT AS line FROM x""")
def deep_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as documents whose symbols are nested up to eight deep, or flat with a location in the older form."""
    part = table(spark, sf_dir, "part")
    point = lambda k: F.struct(F.lit(k).alias("line"), F.lit(2).alias("character"))
    span = lambda k: F.struct(point(k).alias("start"), point(k).alias("end"))
    name = lambda k: F.concat("p_name", F.lit(str(k)))
    tree = F.lit("null")
    for k in range(7, -1, -1):
        own = F.substring(F.to_json(F.struct(name(k).alias("name"), F.lit(5).alias("kind"), span(k).alias("range"), span(k).alias("selectionRange"))), F.lit(2), F.lit(1 << 20))
        here = F.concat(F.lit('[{"children":'), tree, F.lit(","), own, F.lit("]"))
        tree = F.when(F.col("p_size") % 8 >= k, here).otherwise(F.lit("null"))
    where = F.struct(F.lit("file:///x.c").alias("uri"), span(0).alias("range"))
    flat = F.to_json(F.array(F.struct(name(0).alias("name"), F.lit(12).alias("kind"), F.lit("box").alias("containerName"), where.alias("location"))))
    rows = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 == 0, flat).otherwise(tree).alias("result"), F.lit(None).cast("string").alias("error"))
    found = messages.document_symbols(rows)
    return found.select("id", F.array_join("path", "/").alias("path"), "name", "qualified_name", "detail", "container_name", "location.line")


@query("""WITH s AS (SELECT s_nationkey AS id, s_suppkey AS k, s_name AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS place FROM supplier)
SELECT id, place::INT AS at, n AS name, CASE k % 3 WHEN 0 THEN 'box::' || n ELSE n END AS qualified_name, CASE k % 4 WHEN 0 THEN 12 WHEN 1 THEN 6 WHEN 2 THEN 13 ELSE 5 END::INT AS kind,
'/w/' || n || '.c' AS file_path, CASE k % 2 WHEN 0 THEN k + 1 ELSE 0 END::INT AS line, CASE k % 2 WHEN 0 THEN 3 ELSE 0 END::INT AS "column", CASE k % 3 WHEN 0 THEN 'box' END AS container_name FROM s""")
def workspace_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as answers with their suppliers as symbols, every other one with no more than a URI."""
    k = F.col("s_suppkey")
    point = lambda c: F.struct(k.alias("line"), F.lit(c).alias("character"))
    span = F.when(k % 2 == 0, F.struct(point(2).alias("start"), point(7).alias("end")))
    where = F.struct(F.concat(F.lit("file:///w/"), F.replace("s_name", F.lit("#"), F.lit("%23")), F.lit(".c")).alias("uri"), span.alias("range"))
    kind = F.get(F.array(*[F.lit(x) for x in (12, 6, 13, 5)]), (k % 4).cast("int"))
    symbol = F.struct(F.col("s_name").alias("name"), kind.alias("kind"), F.when(k % 3 == 0, "box").alias("containerName"), where.alias("location"))
    answers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", symbol.alias("symbol")))).alias("x"))
    rows = answers.select("id", F.to_json(F.transform("x", lambda x: x["symbol"])).alias("result"), F.lit(None).cast("string").alias("error"))
    found = messages.workspace_symbols(rows)
    return found.select("id", "at", "name", "qualified_name", "kind", "location.file_path", "location.line", "location.column", "container_name")


@query("""WITH x AS (SELECT l_orderkey AS id, l_partkey AS p, l_linenumber AS n, unnest(range(0, 1 + l_linenumber % 3)) AS r FROM lineitem)
SELECT id, 'part ' || p AS name, CASE p % 2 WHEN 0 THEN 'lib::part ' || p ELSE 'part ' || p END AS qualified_name, '/src/part ' || p || '.c' AS call_file, (n + r + 1)::INT AS call_line FROM x""")
def incoming_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as answers with an incoming call each, from one place to three in the caller's file; some from none."""
    part, n = F.col("l_partkey"), F.col("l_linenumber")
    point = lambda line, c: F.struct(line.cast("int").alias("line"), F.lit(c).alias("character"))
    span = lambda a: F.struct(point(a, 2).alias("start"), point(a, 6).alias("end"))
    named = F.concat(F.lit("part "), part.cast("string"))
    caller = F.struct(
        named.alias("name"), F.lit(12).alias("kind"), F.when(part % 2 == 0, "lib").alias("detail"),
        F.concat(F.lit("file:///src/part%20"), part.cast("string"), F.lit(".c")).alias("uri"), span(part).alias("range"), span(part).alias("selectionRange"))
    places = F.slice(F.array(span(n), span(n + 1), span(n + 2)), 1, (1 + n % 3).cast("int"))
    result = F.to_json(F.array(F.struct(caller.alias("from"), places.alias("fromRanges"))))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), result.alias("result"), F.lit(None).cast("string").alias("error"))
    found = messages.call_sites(rows, outgoing=False)
    return found.select("id", "item.name", "item.qualified_name", F.col("call_location.file_path").alias("call_file"), F.col("call_location.line").alias("call_line"))


@query("""SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'references' WHEN 1 THEN 'references' WHEN 2 THEN 'references' WHEN 3 THEN 'outgoing' WHEN 4 THEN 'incoming' WHEN 5 THEN 'prepare'
WHEN 6 THEN 'workspace' WHEN 7 THEN 'document' ELSE 'unknown' END AS kind FROM part""")
def sniffed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What answers to forgotten requests look like, by the keys of their first member."""
    of = lambda *keys: F.to_json(F.array(F.struct(*[F.col("p_name").alias(k) for k in keys])))
    forms = [
        F.lit("null"), F.lit("[]"), of("uri", "range"), of("to", "fromRanges"), of("from", "fromRanges"), of("name", "uri", "range", "selectionRange"),
        of("name", "location"), of("name", "range"), of("other")]
    result = F.element_at(F.array(*forms), (F.col("p_partkey") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", messages.sniffed_kind(result).alias("kind"))
