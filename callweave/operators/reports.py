"""Reports of one row or few: statistics, function info, impact, dependencies, problem areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import CallGraph
from ..schema import ERROR, WARNING
from ..storage import keep
from . import filters, paths, traversal

#: Fixed value: call sites from which on a function counts as highly connected.
HIGHLY_CONNECTED = 5


def _per_function(g: CallGraph) -> DataFrame:
    """id, n_callers, n_callees, n_diagnostics, n_errors, n_warnings of every function; each table is read once."""
    found = g.diagnostics.groupBy(F.col("function_id").alias("id")).agg(
        F.count("*").alias("n_diagnostics"), F.count_if(F.col("severity") == ERROR).alias("n_errors"), F.count_if(F.col("severity") == WARNING).alias("n_warnings"))
    out = g.degrees().join(found, "id", "left")
    return out.fillna(0, ["n_diagnostics", "n_errors", "n_warnings"])


def graph_stats(g: CallGraph) -> DataFrame:
    """Totals; calls count even where an end is missing, also in the average per function, which is 0 without functions."""
    per = _per_function(g).agg(
        F.count("*").alias("total_functions"), F.count_if(F.col("n_callers") == 0).alias("entry_points"),
        F.count_if(F.col("n_callees") == 0).alias("leaf_functions"), F.count_if(F.col("n_diagnostics") > 0).alias("with_diagnostics"))
    calls = g.calls.agg(F.count("*").alias("total_calls"))
    # One row by one row.
    return per.join(calls, F.lit(True)).select(
        "total_functions", "total_calls", "entry_points", "leaf_functions", "with_diagnostics",
        F.when(F.col("total_functions") > 0, F.col("total_calls") / F.col("total_functions")).otherwise(0.0).alias("avg_calls"))


def function_info(g: CallGraph, id_: str) -> DataFrame:
    """One row, or none for an unknown id. Of functions no more are looked up than it and those that its call sites name."""
    sites = keep(g.sites.select("src", "dst"))
    near = keep(sites.filter((F.col("src") == id_) | (F.col("dst") == id_)).select(F.col("src").alias("caller"), F.col("dst").alias("callee")))
    ends = near.select(F.explode(F.array("caller", "callee")).alias("id")).unionByName(traversal.one(sites, id_)).distinct()
    known = keep(g.functions.select("id", "name", "qualified_name").join(ends, "id", "left_semi"))
    row = _per_function(CallGraph(known, near, g.references, g.diagnostics.filter(F.col("function_id") == id_))).filter(F.col("id") == id_)
    reached = traversal.both_ways(traversal.Roads(sites, once=True), id_).agg(F.count_if("on").alias("n_reachable"), F.count_if(~F.col("on")).alias("n_can_reach"))
    named = known.filter(F.col("id") == id_).join(row, "id")
    return named.join(reached, F.lit(True)).select(
        "id", "name", "qualified_name", "n_callers", "n_callees", "n_reachable", "n_can_reach",
        (F.col("n_diagnostics") > 0).alias("has_diagnostics"), "n_errors", "n_warnings")


def impact(g: CallGraph, id_: str, max_depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A row (direct, total, max_depth), and (id, depth) of what it calls and of what calls it.

    direct counts call sites, total all that can reach it, itself included; max_depth is only returned.
    """
    up = traversal.call_depth(g.reversed_sites, id_)
    direct = g.callers(id_).agg(F.count("*").alias("direct"))
    row = direct.join(up.agg(F.count("*").alias("total")), F.lit(True)).withColumn("max_depth", F.lit(max_depth).cast("long"))
    return row, traversal.call_depth(g.sites, id_), up


def dependencies(g: CallGraph, id_: str, max_depth: int) -> DataFrame:
    """A row: direct, total, and what path_analysis tells; depth_limit is only returned."""
    direct = g.callees(id_).agg(F.count("*").alias("direct"))
    found = paths.path_analysis(g.sites, id_)
    return direct.join(found, F.lit(True)).select(
        "direct", F.col("total_paths").alias("total"), "total_paths", F.col("max_depth"), "avg_depth", F.lit(max_depth).cast("long").alias("depth_limit"))


def problem_areas(g: CallGraph) -> DataFrame:
    """(area, id) of functions with errors, with warnings and with many call sites."""
    per = _per_function(g)
    areas = F.array(
        F.when(F.col("n_errors") > 0, "error"), F.when(F.col("n_warnings") > 0, "warning"),
        F.when(F.col("n_callers") + F.col("n_callees") >= HIGHLY_CONNECTED, "highly_connected"))
    return per.select(F.explode(F.array_compact(areas)).alias("area"), "id")


def problem_counts(g: CallGraph) -> DataFrame:
    """A row: how many functions have errors, warnings or many call sites, how many are entry points and leaves."""
    return _per_function(g).agg(
        F.count_if(F.col("n_errors") > 0).alias("errors"), F.count_if(F.col("n_warnings") > 0).alias("warnings"),
        F.count_if(F.col("n_callers") + F.col("n_callees") >= HIGHLY_CONNECTED).alias("highly_connected"),
        F.count_if(F.col("n_callers") == 0).alias("entry_points"), F.count_if(F.col("n_callees") == 0).alias("leaf_functions"))


def search_functions(g: CallGraph, query: str) -> DataFrame:
    """Functions whose name or file has the query in it, each once, by name."""
    return filters.where(g, filters.name_contains(query) | filters.file_contains(query)).orderBy("name", "id")
