"""Call graphs made of the driver's tables.

lines: parts call one another along the lines of an order. tables: regions call nations, these their
customers and suppliers, customers their orders, orders their parts and suppliers; suppliers aren't
functions, so that calls to them lead nowhere. transitions: a user's event types in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import qualified_name
from ..graph import CallGraph
from ..schema import ERROR, HINT, INFORMATION, WARNING, location

#: Calls within one order, and calls to suppliers after all others.
WITHIN, LATER = 1000, 10**15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def call(seq: Column, caller: Column, callee: Column, file: Column, line: Column, column: Column) -> list[Column]:
    return [seq.cast("long").alias("seq"), caller.alias("caller"), callee.alias("callee"), location(file, line, column).alias("call_location")]


def line_order() -> Window:
    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")


def diagnostics(spark: SparkSession, sf_dir: str, prefix: str = "") -> DataFrame:
    """A diagnostic per event but purchases, of the function that has the user's number."""
    e = table(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "error", ERROR).when(F.col("event_type") == "click", WARNING).when(F.col("event_type") == "view", INFORMATION).when(F.col("event_type") == "signup", HINT)
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit(prefix), text("user_id")).alias("function_id"),
        location(F.lit("events"), F.col("event_id") + 1, F.lit(0)).alias("location"), severity.cast("int").alias("severity"),
        F.col("event_type").alias("message"), F.lit(None).cast("string").alias("code")).filter("severity is not null")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference per line, of its part by its supplier; lines that weren't judged have no symbol."""
    kind = F.when(F.col("l_returnflag") == "R", "Function").when(F.col("l_returnflag") == "A", "Variable")
    name = F.concat(F.lit("Supplier#"), text("l_suppkey"))
    symbol = F.when(kind.isNotNull(), F.struct(name.alias("name"), name.alias("qualified_name"), kind.alias("kind")))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * WITHIN + F.col("l_linenumber")).alias("seq"), text("l_partkey").alias("function_id"),
        location(F.concat(F.lit("order/"), text("l_orderkey")), F.col("l_linenumber"), F.lit(1)).alias("location"), symbol.alias("referencing_symbol"))


def line_graph(spark: SparkSession, sf_dir: str) -> CallGraph:
    part = table(spark, sf_dir, "part")
    functions = part.select(
        F.col("p_partkey").cast("long").alias("seq"), text("p_partkey").alias("id"), F.col("p_name").alias("name"), qualified_name(F.col("p_brand"), F.col("p_name")).alias("qualified_name"),
        location(F.concat(F.lit("src/"), "p_type", F.lit(".c")), F.col("p_partkey") + 1, F.lit(1)).alias("definition_location"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    steps = lines.select("*", F.lead("l_partkey").over(line_order()).alias("b"), F.row_number().over(line_order()).alias("k")).filter("b is not null")
    calls = steps.select(*call(
        F.col("l_orderkey") * WITHIN + F.col("k"), text("l_partkey"), text("b"),
        F.concat(F.lit("order/"), text("l_orderkey")), F.col("l_linenumber"), F.col("k")))
    return CallGraph(functions, calls, references(spark, sf_dir), diagnostics(spark, sf_dir))


def table_graph(spark: SparkSession, sf_dir: str) -> CallGraph:
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "orders", "part", "lineitem")}

    def functions_of(name: str, key: str, label: Column, first: int) -> DataFrame:
        return t[name].select(
            (F.col(key).cast("long") + first).alias("seq"), F.concat(F.lit(name[0].upper()), text(key)).alias("id"), label.alias("name"),
            qualified_name(F.lit(name), label).alias("qualified_name"), location(F.lit(f"src/{name}.c"), F.col(key) + 1, F.lit(1)).alias("definition_location"))

    functions = (
        functions_of("region", "r_regionkey", F.col("r_name"), 0)
        .unionByName(functions_of("nation", "n_nationkey", F.col("n_name"), LATER))
        .unionByName(functions_of("customer", "c_custkey", F.col("c_name"), 2 * LATER))
        .unionByName(functions_of("orders", "o_orderkey", F.concat(F.lit("Order#"), text("o_orderkey")), 3 * LATER))
        .unionByName(functions_of("part", "p_partkey", F.col("p_name"), 4 * LATER)))

    def named(letter: str, key: str) -> Column:
        return F.concat(F.lit(letter), text(key))

    lines = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", F.row_number().over(line_order()).alias("k"))
    # A line calls its part and its supplier: one pass over the lines.
    ends = F.explode(F.array(F.struct(F.lit(0).alias("later"), named("P", "l_partkey").alias("to")), F.struct(F.lit(LATER).alias("later"), named("S", "l_suppkey").alias("to"))))
    of_lines = lines.select("l_orderkey", "k", ends.alias("e"))
    calls = (
        t["nation"].select(*call(F.col("n_nationkey"), named("R", "n_regionkey"), named("N", "n_nationkey"), F.lit("src/region.c"), F.col("n_nationkey") + 1, F.lit(1)))
        .unionByName(t["customer"].select(*call(F.col("c_custkey"), named("N", "c_nationkey"), named("C", "c_custkey"), F.lit("src/nation.c"), F.col("c_custkey") + 1, F.lit(1))))
        .unionByName(t["supplier"].select(*call(F.col("s_suppkey") + LATER, named("N", "s_nationkey"), named("S", "s_suppkey"), F.lit("src/nation.c"), F.col("s_suppkey") + 1, F.lit(2))))
        .unionByName(t["orders"].select(*call(F.col("o_orderkey"), named("C", "o_custkey"), named("O", "o_orderkey"), F.lit("src/customer.c"), F.col("o_orderkey") + 1, F.lit(1))))
        .unionByName(of_lines.select(*call(F.col("l_orderkey") * WITHIN + F.col("k") + F.col("e.later"), named("O", "l_orderkey"), F.col("e.to"), F.lit("src/orders.c"), F.col("l_orderkey") + 1, F.col("k")))))
    none = references(spark, sf_dir).limit(0)
    return CallGraph(functions, calls, none, diagnostics(spark, sf_dir, "C"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, n): event types of a user that follow one another, and how often."""
    turn = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(turn).alias("dst"))
    return steps.filter("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))
