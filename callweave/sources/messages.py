"""Language-server JSON messages as rows: envelopes, results by kind, requests.

Schemas are declared; what doesn't fit one is null, and an answer with an error, or with no result, has
no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import call_qualified_name, location_of_range, path_of_uri, qualified_name, reference_kind, symbol_id
from ..schema import FUNCTIONS, location
from ..storage import keep

ENVELOPE = "jsonrpc string, id bigint, method string, result string, error struct<code:int,message:string>"
POSITION = "struct<line:int,character:int>"
RANGE = f"struct<start:{POSITION},end:{POSITION}>"
LOCATIONS = f"array<struct<uri:string,range:{RANGE}>>"
ITEM = f"struct<name:string,kind:int,detail:string,uri:string,range:{RANGE},selectionRange:{RANGE}>"
WORKSPACE = f"array<struct<name:string,kind:int,containerName:string,location:struct<uri:string,range:{RANGE}>>>"
TREE = f"array<struct<name:string,detail:string,kind:int,containerName:string,range:{RANGE},selectionRange:{RANGE},location:struct<uri:string,range:{RANGE}>,children:string>>"
# Methods that answer with locations, kinds of symbols that are loaded, and what an error without text says.
PREPARE, INCOMING, OUTGOING = "textDocument/prepareCallHierarchy", "callHierarchy/incomingCalls", "callHierarchy/outgoingCalls"
#: A frame's header.
HEADER = r"(?:[A-Za-z-]+:[^\r\n]*\r\n)*?Content-Length: *([0-9]+)\r\n(?:[A-Za-z-]+:[^\r\n]*\r\n)*\r\n"
REFERENCES = ("textDocument/references", "textDocument/references_enhanced")
LOADED_KINDS = (12, 6, 9)
UNKNOWN_ERROR = "Unknown LSP error"
#: Rows of functions that answers bring.
FUNCTION_ROW = FUNCTIONS


def envelopes(messages: DataFrame, column: str = "value") -> DataFrame:
    """The columns of the messages, and m: (jsonrpc, id, method, result as JSON, error)."""
    return messages.withColumn("m", F.from_json(column, ENVELOPE))


def unframed(streams: DataFrame, column: str = "value") -> DataFrame:
    """Rows with a text of frames -> (..., at, body), a row for each whole frame in order; of the last one what is cut off waits.

    Headers can't stand inside of a body, as JSON texts hold no bare line ends.
    """
    lengths = F.regexp_extract_all(column, F.lit(HEADER), F.lit(1))
    bodies = F.slice(F.split(column, HEADER), 2, F.size(lengths) + 1)
    frames = F.arrays_zip(lengths.alias("n"), bodies.alias("body"))
    rest = [c for c in streams.columns if c != column]
    rows = streams.select(*rest, F.posexplode(frames).alias("at", "x")).select(*rest, "at", F.col("x.n").cast("int").alias("n"), F.encode("x.body", "UTF-8").alias("body"))
    return rows.filter(F.octet_length("body") >= F.col("n")).select(*rest, "at", F.decode(F.substring("body", F.lit(1), F.col("n")), "UTF-8").alias("body"))


def malformed(rows: DataFrame, kind: str) -> DataFrame:
    """(id, message) of answers whose result is there and isn't of this kind, an array; they are errors, not empty."""
    there = rows.filter("error is null and result is not null and trim(result) <> 'null'")
    fits = F.startswith(F.ltrim("result"), F.lit("[")) & F.from_json("result", kind).isNotNull()
    return there.filter(~fits).select("id", F.lit("Unexpected result").alias("message"))


def answers(messages: DataFrame, pending: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """Answers to pending(id, method) requests of these methods: (id, method, result, error); others are left out."""
    rows = messages.filter("m.id is not null and m.method is null").select("m.id", "m.result", "m.error")
    return rows.join(pending.filter(F.col("method").isin(*methods)).select("id", "method"), "id")


def _results(rows: DataFrame, kind: str) -> DataFrame:
    """(id, at, x) for each member of the results that are there and without an error."""
    return rows.filter("error is null").select("id", F.posexplode(F.from_json("result", kind)).alias("at", "x"))


def errors(rows: DataFrame) -> DataFrame:
    """(id, message) of answers with an error, as a caller is told of them."""
    return rows.filter("error is not null").select("id", F.coalesce("error.message", F.lit(UNKNOWN_ERROR)).alias("message"))


def locations(rows: DataFrame) -> DataFrame:
    """(id, at, location) of found references, counted from 1."""
    return _results(rows, LOCATIONS).select("id", "at", location_of_range(F.col("x.uri"), F.col("x.range.start"), F.col("x.range.end")).alias("location"))


def workspace_symbols(rows: DataFrame) -> DataFrame:
    """(id, at, name, qualified_name, kind, location, container_name); a location that is only a URI is line 0, column 0."""
    whole = location_of_range(F.col("x.location.uri"), F.col("x.location.range.start"), F.col("x.location.range.end"))
    bare = location(path_of_uri(F.col("x.location.uri")), 0, 0)
    return _results(rows, WORKSPACE).select(
        "id", "at", "x.name", qualified_name(F.col("x.containerName"), F.col("x.name")).alias("qualified_name"), "x.kind",
        F.when(F.col("x.location.range").isNull(), bare).otherwise(whole).alias("location"), F.col("x.containerName").alias("container_name"))


def loadable(symbols: DataFrame, most: int = 200) -> DataFrame:
    """Functions, methods and constructors, the first so many by answer and place."""
    return symbols.filter(F.col("kind").isin(*LOADED_KINDS)).orderBy("id", "at").limit(most)


def document_symbols(rows: DataFrame) -> DataFrame:
    """(id, path, name, qualified_name, kind, detail, container_name, location, range, around): the symbols of documents, nested ones by a join for each level, however many there are.

    path numbers a symbol and those around it, so that its order is that of the document. Lines and
    columns are counted from 0 and files are blank, as the answer has them. Flat symbols with a location
    of their own, the older form, are in no container: theirs is their detail. around holds the ranges of
    the symbols around.
    """
    level = rows.filter("error is null").select("id", F.array().cast("array<int>").alias("path"), F.array().cast(f"array<{RANGE}>").alias("around"), F.lit(None).cast("string").alias("container"), F.col("result").alias("text"))
    levels = []
    while not levels or not levels[-1].isEmpty():
        found = level.select("id", "path", "around", "container", F.posexplode(F.from_json("text", TREE)).alias("at", "x"))
        levels.append(keep(found.select("id", F.array_append("path", F.col("at")).alias("path"), "around", "container", "x")))  # a level is parsed once
        level = levels[-1].filter("x.children is not null").select("id", "path", F.array_append("around", F.col("x.range")).alias("around"), F.col("x.name").alias("container"), F.col("x.children").alias("text"))
    flat = F.col("x.location").isNotNull()
    s = F.coalesce("x.selectionRange", "x.range", "x.location.range")
    length = F.when(s["start"]["line"] == s["end"]["line"], s["end"]["character"] - s["start"]["character"])
    return reduce(DataFrame.unionByName, levels).select(
        "id", "path", "x.name", qualified_name(F.col("container"), F.col("x.name")).alias("qualified_name"), "x.kind",
        F.when(flat, F.col("x.containerName")).otherwise(F.col("x.detail")).alias("detail"), F.col("container").alias("container_name"),
        location("", s["start"]["line"], s["start"]["character"], length).alias("location"), F.coalesce("x.range", "x.location.range").alias("range"), "around")


def _item(x: Column) -> Column:
    """A call-hierarchy item as a function."""
    start = x["selectionRange"]["start"]
    return F.struct(
        x["name"].alias("name"), call_qualified_name(x["detail"], x["name"]).alias("qualified_name"), reference_kind(x["kind"]).alias("kind"),
        location(path_of_uri(x["uri"]), start["line"] + 1, start["character"] + 1).alias("definition_location"))


def prepared_items(rows: DataFrame) -> DataFrame:
    """(id, at, item) of prepared call hierarchies; a caller goes on with the first of each."""
    return _results(rows, f"array<{ITEM}>").select("id", "at", _item(F.col("x")).alias("item"))


def call_sites(rows: DataFrame, outgoing: bool, asked: DataFrame | None = None) -> DataFrame:
    """(id, item, call_location): the other end of each call and where the call stands, a row for each range.

    Ranges are in the caller's document: of outgoing calls that of the function asked for, asked(id, file_path);
    without it, and for incoming calls, the other end's.
    """
    side = "to" if outgoing else "from"
    found = _results(rows, f"array<struct<`{side}`:{ITEM},fromRanges:array<{RANGE}>>>")
    each = found.select("id", F.col(f"x.{side}").alias("other"), F.explode("x.fromRanges").alias("r"))
    file = path_of_uri(F.col("other.uri"))
    if outgoing and asked is not None:
        each = each.join(asked.select("id", F.col("file_path").alias("_file")), "id", "left")
        file = F.coalesce("_file", file)
    length = F.when(F.col("r.start.line") == F.col("r.end.line"), F.col("r.end.character") - F.col("r.start.character"))
    return each.select("id", _item(F.col("other")).alias("item"), location(file, F.col("r.start.line") + 1, F.col("r.start.character") + 1, length).alias("call_location"))


def found_calls(sites: DataFrame, asked: DataFrame, outgoing: bool) -> tuple[DataFrame, DataFrame]:
    """Rows for `CallGraph.add_functions` and `add_calls`: call_sites of answers to asked(id, function_id), which know the graph's side."""
    at = F.col("item.definition_location")
    other = symbol_id(F.col("item.qualified_name"), at["file_path"], at["line"])
    rows = sites.join(asked.select("id", "function_id"), "id").withColumn("other", other)
    functions = rows.groupBy(F.col("other").alias("id")).agg(F.min(F.struct(F.col("id").alias("seq"), "item")).alias("x"))
    functions = functions.select("id", "x.item.name", "x.item.qualified_name", F.col("x.item.definition_location").alias("definition_location"), F.col("x.seq").cast("long").alias("seq"))
    ends = ("function_id", "other") if outgoing else ("other", "function_id")
    calls = rows.select(F.col(ends[0]).alias("caller"), F.col(ends[1]).alias("callee"), "call_location", F.col("id").cast("long").alias("seq"))
    return functions, calls


def loaded_functions(rows: DataFrame) -> DataFrame:
    """Rows for `CallGraph.add_functions` of found workspace symbols that are functions."""
    at = F.col("location")
    found = workspace_symbols(rows).filter(F.col("kind").isin(*LOADED_KINDS))
    return found.select(
        symbol_id(F.col("qualified_name"), at["file_path"], at["line"]).alias("id"), "name", "qualified_name", at.alias("definition_location"), F.col("id").cast("long").alias("seq"))


def expansions(rows: DataFrame, outgoing: bool = False) -> DataFrame:
    """(id, state, follow_up) of answers to prepared hierarchies: the request for the calls of the first item, or Loaded if there is none."""
    first = F.get(F.from_json("result", "array<string>"), 0)
    done = first.isNull()
    method = OUTGOING if outgoing else INCOMING
    text = F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.col("id").cast("string"), F.lit(f',"method":"{method}","params":{{"item":'), first, F.lit("}}"))
    return rows.filter("error is null").select("id", F.when(done, "Loaded").otherwise("Loading").alias("state"), text.alias("follow_up"))


def sniffed_kind(result: Column) -> Column:
    """What an answer to a forgotten request looks like, by its first member."""
    first = F.get(F.from_json(result, "array<map<string,string>>"), 0)
    has = lambda *keys: reduce(lambda a, b: a & b, [F.map_contains_key(first, k) for k in keys])
    empty = result.isNull() | F.trim(result).isin("[]", "null")
    return (
        F.when(empty, "references").when(has("from", "fromRanges"), "incoming").when(has("to", "fromRanges"), "outgoing")
        .when(has("uri", "range", "selectionRange"), "prepare").when(has("uri", "range"), "references").when(has("location", "name"), "workspace")
        .when(has("name", "range"), "document").otherwise("unknown"))


def request(id_: Column, method: str | Column, params: Column) -> Column:
    """A request as its JSON text."""
    method = F.lit(method) if isinstance(method, str) else method
    return F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), id_.alias("id"), method.alias("method"), params.alias("params")))


def notification(method: str, params: Column) -> Column:
    return F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.lit(method).alias("method"), params.alias("params")))


def framed(text: Column) -> Column:
    """The text under a header with its length in bytes."""
    return F.concat(F.lit("Content-Length: "), F.octet_length(text).cast("string"), F.lit("\r\n\r\n"), text)


def position_params(uri: Column, line: Column, character: Column, declaration: bool | None = None) -> Column:
    """Parameters of a request at a position counted from 0; with `declaration`, of one for references."""
    fields = [F.struct(uri.alias("uri")).alias("textDocument"), F.struct(line.alias("line"), character.alias("character")).alias("position")]
    if declaration is not None:
        fields.append(F.struct(F.lit(declaration).alias("includeDeclaration")).alias("context"))
    return F.struct(*fields)


def _document(uri: Column) -> Column:
    return F.struct(uri.alias("uri"))


def references_request(id_: Column, uri: Column, line: Column, character: Column) -> Column:
    return request(id_, REFERENCES[0], position_params(uri, line, character, declaration=True))


def enhanced_references_request(id_: Column, uri: Column, line: Column, character: Column) -> tuple[Column, Column]:
    """(request, method it is pending as): the same message, whose answer is joined with the symbols around each place."""
    return references_request(id_, uri, line, character), F.lit(REFERENCES[1])


def hover_request(id_: Column, uri: Column, line: Column, character: Column) -> Column:
    return request(id_, "textDocument/hover", position_params(uri, line, character))


def prepare_request(id_: Column, uri: Column, line: Column, character: Column) -> Column:
    return request(id_, PREPARE, position_params(uri, line, character))


def calls_request(id_: Column, item: Column, outgoing: bool) -> Column:
    return request(id_, OUTGOING if outgoing else INCOMING, F.struct(item.alias("item")))


def workspace_request(id_: Column, query: Column) -> Column:
    return request(id_, "workspace/symbol", F.struct(query.alias("query")))


def symbols_request(id_: Column, uri: Column) -> Column:
    return request(id_, "textDocument/documentSymbol", F.struct(_document(uri).alias("textDocument")))


def initialize_request(id_: Column, root_uri: Column, process: int, client: str, version: str) -> Column:
    """The root is a workspace folder named by the last part of its path."""
    plain = lambda: F.struct(F.lit(False).alias("dynamicRegistration"))
    folder = F.struct(root_uri.alias("uri"), F.coalesce(F.nullif(F.substring_index(root_uri, "/", -1), F.lit("")), F.lit("workspace")).alias("name"))
    can = F.struct(F.struct(plain().alias("symbol")).alias("workspace"), F.struct(plain().alias("references"), plain().alias("callHierarchy")).alias("textDocument"))
    who = F.struct(F.lit(client).alias("name"), F.lit(version).alias("version"))
    return request(id_, "initialize", F.struct(F.lit(process).alias("processId"), can.alias("capabilities"), who.alias("clientInfo"), F.array(folder).alias("workspaceFolders")))


def initialized() -> Column:
    return F.lit('{"jsonrpc":"2.0","method":"initialized","params":{}}')


def did_open(uri: Column, language: Column, version: Column, text: Column) -> Column:
    return notification("textDocument/didOpen", F.struct(F.struct(uri.alias("uri"), language.alias("languageId"), version.alias("version"), text.alias("text")).alias("textDocument")))


def did_close(uri: Column) -> Column:
    return notification("textDocument/didClose", F.struct(_document(uri).alias("textDocument")))
