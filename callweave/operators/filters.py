"""Filters over the functions of a call graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import CallGraph, both


def name_contains(pattern: str) -> Column:
    """Name or qualified name has the pattern in it, with regard to case; % and _ are letters like others."""
    return F.contains("name", F.lit(pattern)) | F.contains("qualified_name", F.lit(pattern))


def file_contains(pattern: str) -> Column:
    return F.contains(F.col("definition_location.file_path"), F.lit(pattern))


def where(g: CallGraph, *predicates: Column) -> DataFrame:
    """Functions for which all predicates hold: one filter, whatever their number."""
    return g.functions.filter(both(*predicates))


def where_all(g: CallGraph, *predicates: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Functions for which all predicates hold that Columns can't state: each takes some functions as a pandas frame and returns a truth value for each; later ones see what earlier ones left."""

    def holding(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for p in predicates:
                pdf = pdf[p(pdf).fillna(False).astype(bool).to_numpy()] if len(pdf) else pdf
            yield pdf

    return g.functions.mapInPandas(holding, g.functions.schema) if predicates else g.functions


def with_severity(g: CallGraph, severity: int) -> DataFrame:
    """Functions with a diagnostic of this severity."""
    return g.functions.join(g.diagnostics.filter(F.col("severity") == severity), F.col("id") == F.col("function_id"), "left_semi")


def with_diagnostics(g: CallGraph) -> DataFrame:
    return g.functions.join(g.diagnostics, F.col("id") == F.col("function_id"), "left_semi")


def with_references(g: CallGraph, least: int) -> DataFrame:
    """Functions with so many references at least."""
    if least <= 0:
        return g.functions
    enough = g.references.groupBy("function_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return g.functions.join(enough, F.col("id") == F.col("function_id"), "left_semi")


def entry_points(g: CallGraph) -> DataFrame:
    """Functions that no function that is there calls; one that calls itself is none."""
    called = g.edges.join(g.functions.select(F.col("id").alias("src")), "src", "left_semi")
    return g.functions.join(called, F.col("id") == F.col("dst"), "left_anti")


def leaves(g: CallGraph) -> DataFrame:
    """Functions that call no function that is there."""
    calling = g.edges.join(g.functions.select(F.col("id").alias("dst")), "dst", "left_semi")
    return g.functions.join(calling, F.col("id") == F.col("src"), "left_anti")


def highly_connected(g: CallGraph, least: int) -> DataFrame:
    """id, degree: functions with so many call sites in and out at least."""
    return g.degrees().select("id", (F.col("n_callers") + F.col("n_callees")).alias("degree")).filter(F.col("degree") >= least)
