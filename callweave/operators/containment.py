"""Joins by containment: which symbol a position stands in, and which paths belong to a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a block: ranges meet positions of the blocks they touch only.
LINES = 512
#: Characters that two strings are joined by before one is looked for in the other.
GRAM = 8
#: Sorts a symbol after those inside it.
INSIDE_FIRST = 2147483647


def inside(at: Column, range_: Column) -> Column:
    """Whether a position (line, character) is in a range, both of its ends included."""
    return (at >= range_["start"]) & (at <= range_["end"])


def containing_symbol(positions: DataFrame, symbols: DataFrame) -> DataFrame:
    """positions(pos_id, file, at), symbols(file, path, range, around, symbol) -> (pos_id, symbol), with null where there is none.

    at is (line, character), range (start, end), path the numbers of a symbol and those around it among
    their siblings, around their ranges. Of siblings that hold a position the first counts, and the
    deepest one below it.
    """
    block = lambda p: F.floor(p["line"] / LINES)
    spread = symbols.select("file", "path", "range", "around", "symbol", F.explode(F.sequence(block(F.col("range.start")), F.greatest(block(F.col("range.start")), block(F.col("range.end"))))).alias("_block"))
    at = positions.select("pos_id", "file", "at", block(F.col("at")).alias("_block"))
    hit = at.join(spread, ["file", "_block"]).filter(inside(F.col("at"), F.col("range")) & F.forall("around", lambda r: inside(F.col("at"), r)))
    order = F.concat("path", F.array(F.lit(INSIDE_FIRST)))
    found = hit.groupBy("pos_id").agg(F.min(F.struct(order.alias("order"), "symbol")).alias("_of"))
    return positions.select("pos_id").join(found, "pos_id", "left").select("pos_id", F.col("_of.symbol").alias("symbol"))


def enhanced_references(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """References(pos_id, file, at, ...) with the symbol of their own file that they stand in; without one it is null."""
    return references.join(containing_symbol(references.select("pos_id", "file", "at"), symbols), "pos_id", "left")


def _found_in(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Pairs (text, key) of distinct strings, the key in the text and neither empty: joined by the key's first characters."""
    first = keys.filter(F.length("key") > 0).select("key", F.least(F.length("key"), F.lit(GRAM)).alias("n")).withColumn("gram", F.substring("key", F.lit(1), F.col("n")))
    lengths = first.select("n").distinct()  # at most GRAM rows
    grams = texts.join(F.broadcast(lengths), F.length("text") >= F.col("n")).select("text", "n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - F.col("n") + 1), lambda i: F.substring(F.col("text"), i, F.col("n"))))).alias("gram"))
    return grams.join(first, ["n", "gram"]).filter(F.contains("text", F.col("key"))).select("text", "key")


def project_paths(rows: DataFrame, column: str, project: DataFrame) -> DataFrame:
    """Rows whose path has the path of a project file in it, or is in one; all rows without project files. An empty path is in all, and all have an empty file in them."""
    files = project.select(F.col(project.columns[0]).alias("file")).filter("file is not null").distinct()
    if files.isEmpty() or not files.filter("file = ''").isEmpty():
        return rows
    paths = rows.select(F.col(column).alias("path")).filter("path is not null").distinct()
    has = _found_in(paths.withColumnRenamed("path", "text"), files.withColumnRenamed("file", "key")).select(F.col("text").alias("_path"))
    is_in = _found_in(files.withColumnRenamed("file", "text"), paths.withColumnRenamed("path", "key")).select(F.col("key").alias("_path"))
    good = has.unionByName(is_in).unionByName(paths.filter("path = ''").withColumnRenamed("path", "_path")).distinct()
    return rows.join(good, rows[column] == good["_path"], "left_semi")
