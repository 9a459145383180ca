"""Ranked symbol search: the best fifty by score, then name and id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fuzzy_score
from ..graph import CallGraph

#: Fixed value: results of a search.
MOST = 50


def search(g: CallGraph, query: str, mode: str = "fuzzy") -> DataFrame:
    """id, name, file_path, line, score; mode: fuzzy, exact (part of the name) or path (part of the file's path). An empty query finds everything at score 1."""
    at = F.col("definition_location")
    found = g.functions.select("id", "name", at["file_path"].alias("file_path"), at["line"].alias("line"))
    if not query:
        score = F.lit(1.0)
    elif mode == "fuzzy":
        score = fuzzy_score(F.lit(query), F.col("name"))
    else:
        column = {"exact": "name", "path": "file_path"}[mode]
        score = F.when(F.contains(F.lower(column), F.lower(F.lit(query))), F.lit(1.0))
    scored = found.withColumn("score", score.cast("float")).filter("score is not null")
    return scored.orderBy(F.desc("score"), "name", "id").limit(MOST)


def scroll_offset(selected: int, offset: int, height: int) -> int:
    """First row to show so that the selected one, counted from 0, stays in sight."""
    return selected if selected < offset else max(offset, selected - height + 1)


def scrolled(results: DataFrame, offset: int, height: int) -> DataFrame:
    """The rows of search results, of which there are MOST at most, that a window shows."""
    at = F.row_number().over(Window.orderBy(F.desc("score"), "name", "id")) - 1
    return results.withColumn("at", at).filter(F.col("at").between(offset, offset + height - 1))
