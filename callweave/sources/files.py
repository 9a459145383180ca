"""Sources and sinks: compilation databases, source trees, graphs as tables and as JSON, the demo graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.ids import language_of
from ..graph import CallGraph

COMMANDS = "directory string, command string, file string, arguments array<string>, output string"
# Extensions of source files, folders that are passed over, and how many files a fallback walk takes.
EXTENSIONS = ("c", "cpp", "cxx", "cc", "h", "hpp", "hxx")
SKIPPED = ("target", "build", "node_modules", ".git", ".svn", "dist", "out")
MOST_FILES = 100

NODE = f"struct<seq:bigint,name:string,qualified_name:string,definition_location:{schema.LOCATION}>"
DOCUMENT = f"nodes map<string,{NODE}>, edges array<struct<seq:bigint,caller:string,callee:string,call_location:{schema.LOCATION}>>"


def compile_commands(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """(path) of the files of a compilation database, relative ones under their directory; repeats stay. `existing` (path) leaves out others. A bad database raises."""
    rows = spark.read.schema(COMMANDS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    full = F.when(F.startswith("file", F.lit("/")), F.col("file")).otherwise(F.concat_ws("/", F.regexp_replace("directory", "/+$", ""), "file"))
    files = rows.select(full.alias("path")).filter("path is not null")
    return files if existing is None else files.join(existing.select("path"), "path", "left_semi")


def source_files(spark: SparkSession, root: str, most: int | None = MOST_FILES) -> DataFrame:
    """(path) of source files below a folder, the first by path: what is used where there is no compilation database."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    skipped = "|".join(s.replace(".", "[.]") for s in SKIPPED)
    good = found.filter(F.col("path").rlike(rf"\.({'|'.join(EXTENSIONS)})$") & ~F.col("path").rlike(rf"/({skipped})/"))
    return good if most is None else good.orderBy("path").limit(most)


def save_graph(g: CallGraph, path: str) -> None:
    """The four tables of a graph as Parquet."""
    for name in ("functions", "calls", "references", "diagnostics"):
        getattr(g, name).write.parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> CallGraph:
    """A saved graph; calls that are there twice count once."""
    read = lambda name, s: spark.read.schema(s).parquet(f"{path}/{name}")
    g = CallGraph(read("functions", schema.FUNCTIONS), read("calls", schema.CALLS), read("references", schema.REFERENCES), read("diagnostics", schema.DIAGNOSTICS))
    return CallGraph.empty(spark).add_functions(g.functions).add_calls(g.calls).add_references(g.references).add_diagnostics(g.diagnostics)


def read_graph_json(spark: SparkSession, path: str) -> CallGraph:
    """A graph of JSON documents {nodes: {id: node}, edges: [...]}, of which one fits a task. Rows without a number are numbered by id and place."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    nodes = docs.select(F.explode("nodes").alias("id", "n")).select(F.coalesce("n.seq", F.xxhash64("id")).alias("seq"), "id", "n.name", "n.qualified_name", "n.definition_location")
    edges = docs.select(F.posexplode("edges").alias("at", "e")).select(F.coalesce("e.seq", F.col("at").cast("bigint")).alias("seq"), "e.caller", "e.callee", "e.call_location")
    return CallGraph.empty(spark).add_functions(nodes).add_calls(edges)


#: The tables of a graph that is exchanged as JSON lines, with their schemas.
TABLES = {"functions": schema.FUNCTIONS, "calls": schema.CALLS, "references": schema.REFERENCES, "diagnostics": schema.DIAGNOSTICS}


def write_graph_json(g: CallGraph, path: str) -> None:
    """The four tables of a graph as JSON lines, a folder each: what a graph of any size is exchanged as. `load_graph_json` reads them."""
    for name in TABLES:
        getattr(g, name).write.option("ignoreNullFields", False).json(f"{path}/{name}")


def load_graph_json(spark: SparkSession, path: str) -> CallGraph:
    """A graph written by `write_graph_json`; functions come as they came first, calls that are there twice count once. A line that is no row raises."""
    read = lambda name: spark.read.schema(TABLES[name]).option("mode", "FAILFAST").json(f"{path}/{name}")
    return CallGraph.empty(spark).add_functions(read("functions")).add_calls(read("calls")).add_references(read("references")).add_diagnostics(read("diagnostics"))


def documents(uris: DataFrame) -> DataFrame:
    """(uri, language) of opened documents, each once."""
    return uris.select("uri").distinct().withColumn("language", language_of(F.col("uri")))


def preload_counts(opened: DataFrame) -> DataFrame:
    """opened(uri, ok) -> a row of how many were loaded and failed."""
    return opened.agg(F.count_if("ok").alias("loaded"), F.count_if(~F.col("ok")).alias("failed"))


def demo_graph(spark: SparkSession) -> CallGraph:
    """A small program: seven functions, eight calls, some diagnostics."""
    # Name, qualified name, file, line, references.
    functions = [
        ("main", "main", "src/main.rs", 1, 0), ("initialize", "app::initialize", "src/app.rs", 10, 1), ("process_data", "data::process_data", "src/data.rs", 25, 2),
        ("validate_input", "validation::validate_input", "src/validation.rs", 5, 1), ("risky_operation", "unsafe_module::risky_operation", "src/unsafe_module.rs", 15, 0),
        ("helper_function", "utils::helper_function", "src/utils.rs", 30, 3), ("cleanup", "cleanup::cleanup", "src/cleanup.rs", 8, 0)]
    calls = [
        ("main", "initialize"), ("main", "process_data"), ("initialize", "helper_function"), ("process_data", "validate_input"),
        ("process_data", "risky_operation"), ("process_data", "helper_function"), ("validate_input", "helper_function"), ("main", "cleanup")]
    diagnostics = [("validate_input", 2, "W0100"), ("risky_operation", 1, "E0001"), ("risky_operation", 2, "W0042"), ("helper_function", 3, "I0005")]
    place = {name: (file, line) for name, _, file, line, _ in functions}
    rows = [(i, name, name, qualified, (file, line, 0, None)) for i, (name, qualified, file, line, _) in enumerate(functions)]
    sites = [(i, a, b, (place[a][0], place[a][1] + i + 1, 4, None)) for i, (a, b) in enumerate(calls)]
    refs = [(i, name, (file, line + i + 1, 0, None), None) for name, _, file, line, n in functions for i in range(n)]
    found = [(i, name, (*place[name], 0, None), severity, code, code) for i, (name, severity, code) in enumerate(diagnostics)]
    make = spark.createDataFrame
    return CallGraph(make(rows, schema.FUNCTIONS), make(sites, schema.CALLS), make(refs, schema.REFERENCES), make(found, schema.DIAGNOSTICS))
