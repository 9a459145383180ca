"""The call graph: four tables, and the rules by which rows enter them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema


def first_wins(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Of rows that share keys the one that comes first; ties go to the smallest row.

    Minima are taken before rows are shuffled, so that a key with a third of all rows is no burden.
    """
    rest = [c for c in rows.columns if c not in keys and c != order]
    one = rows.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_first"))
    return one.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in rows.columns])


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows that share keys the one that comes last."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    one = rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_last"))
    return one.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in rows.columns])


def distinct_calls(calls: DataFrame) -> DataFrame:
    """One call per caller, callee, file, line and column, the first; the length is no part of a call's identity."""
    flat = calls.select("*", *[F.col(f"call_location.{c}").alias(f"_{c}") for c in ("file_path", "line", "column")])
    return first_wins(flat, ["caller", "callee", "_file_path", "_line", "_column"]).select(*calls.columns)


@dataclass(frozen=True)
class CallGraph:
    """functions, calls, references and diagnostics as in `schema`. Calls may name functions that aren't there."""

    functions: DataFrame
    calls: DataFrame
    references: DataFrame
    diagnostics: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> CallGraph:
        make = lambda s: spark.createDataFrame([], s)
        return CallGraph(make(schema.FUNCTIONS), make(schema.CALLS), make(schema.REFERENCES), make(schema.DIAGNOSTICS))

    def add_functions(self, functions: DataFrame) -> CallGraph:
        """New functions; an id that is known already stays as it was."""
        return replace(self, functions=first_wins(self.functions.unionByName(functions), ["id"]))

    def add_calls(self, calls: DataFrame) -> CallGraph:
        return replace(self, calls=distinct_calls(self.calls.unionByName(calls)))

    def add_references(self, references: DataFrame) -> CallGraph:
        return replace(self, references=self.references.unionByName(references))

    def add_diagnostics(self, diagnostics: DataFrame) -> CallGraph:
        return replace(self, diagnostics=self.diagnostics.unionByName(diagnostics))

    def refresh_references(self, references: DataFrame) -> CallGraph:
        """References of the functions named replace all that these had."""
        rest = self.references.join(references.select("function_id").distinct(), "function_id", "left_anti")
        return replace(self, references=rest.unionByName(references))

    @property
    def edges(self) -> DataFrame:
        """src, dst: who calls whom, each once, for closures."""
        return self.calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()

    @property
    def reversed_edges(self) -> DataFrame:
        return self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))

    @property
    def sites(self) -> DataFrame:
        """src, dst, seq: call sites, repeats included, in the order that settles ties."""
        return self.calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst"), "seq")

    @property
    def reversed_sites(self) -> DataFrame:
        return self.calls.select(F.col("callee").alias("src"), F.col("caller").alias("dst"), "seq")

    @property
    def resolved_calls(self) -> DataFrame:
        """Calls between functions that are both there."""
        ids = self.functions.select("id")
        return self.calls.join(ids, F.col("caller") == F.col("id"), "left_semi").join(ids, F.col("callee") == F.col("id"), "left_semi")

    def function(self, id_: str) -> DataFrame:
        return self.functions.filter(F.col("id") == id_)

    def function_by_name(self, name: str) -> DataFrame:
        """The first function of exactly this name, if any."""
        return self.functions.filter(F.col("name") == name).orderBy("seq", "id").limit(1)

    def callers(self, id_: str) -> DataFrame:
        """Functions that call this one, a row for each call site."""
        return self.calls.filter(F.col("callee") == id_).select("caller").join(self.functions, F.col("caller") == F.col("id")).select(*self.functions.columns)

    def callees(self, id_: str) -> DataFrame:
        """Functions that this one calls, a row for each call site."""
        return self.calls.filter(F.col("caller") == id_).select("callee").join(self.functions, F.col("callee") == F.col("id")).select(*self.functions.columns)

    def degrees(self) -> DataFrame:
        """id, n_callers, n_callees: call sites whose other end is there; a call of itself counts on both sides.

        Sites move once by callee and once by caller, to learn which of them are there, and are counted before
        they move again; ends that aren't there, or count nothing, don't.
        """
        ids = self.functions.select("id")
        known = ids.distinct()
        there = lambda end: known.select(F.col("id").alias(end), F.lit(True).alias(f"{end}_there"))
        sites = self.calls.select("caller", "callee").join(there("callee"), "callee", "left").join(there("caller"), "caller", "left")
        none, n = F.lit(0).cast("long"), lambda end: F.col(f"{end}_there").isNotNull().cast("long")
        end = lambda of, ins, outs: F.when(F.col(f"{of}_there"), F.struct(F.col(of).alias("id"), ins.alias("ins"), outs.alias("outs")))
        ends = sites.select(F.explode(F.array(end("callee", n("caller"), none), end("caller", none, n("callee")))).alias("e")).filter("e.ins + e.outs > 0")
        counts = ends.groupBy("e.id").agg(F.sum("e.ins").alias("n_callers"), F.sum("e.outs").alias("n_callees"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        return ids.join(counts, "id", "left").select("id", zero("n_callers"), zero("n_callees"))

    def calling_symbols(self) -> DataFrame:
        """function_id, seq, name: the functions, methods and constructors that refer to a function."""
        kind = F.col("referencing_symbol.kind")
        return self.references.filter(kind.isin(*schema.CALLING_KINDS)).select("function_id", "seq", F.col("referencing_symbol.name").alias("name"))

    def symbols_of_kind(self, kind: str) -> DataFrame:
        return self.references.filter(F.col("referencing_symbol.kind") == kind).select("function_id", "seq", "referencing_symbol.*")

    def reference_locations(self) -> DataFrame:
        return self.references.select("function_id", "seq", "location.*")


def both(*parts: Column) -> Column:
    """All of the predicates; without any, every row."""
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out
