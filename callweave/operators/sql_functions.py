"""A call graph in SQL: views of its tables, and table functions whose bodies are SQL, so that Catalyst plans them with the query around them.

With the name `cg` there are the views cg_functions(seq, id, name, qualified_name, definition_location),
cg_calls(src, dst, seq) and, with starts, cg_starts (those of cg_functions that are starts, written once) and
cg_walks(start, forth, id, depth), and the functions

- cg_callees_of(of) and cg_callers_of(of) -> (id): a row for each call site,
- cg_simple_paths(head, tail, most) -> (path): simple paths of fewer than `most` edges, as in `paths.all_paths`,
- cg_reachable_from(of) and cg_can_reach(of) -> (id, depth): for ids among the starts; no rows for others, so that
  ids to ask of are best taken from cg_starts: few rows that Spark can broadcast to the walks.

Arguments may be columns of the tables before them (LATERAL), but those of cg_simple_paths, which recurses.
It walks back from the tail, and raises above the session's spark.sql.cteRecursionRowLimit rows in
all; `paths.all_paths` knows no such bound. A query takes the tables as they are when it is stated: names
may be registered anew after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import CallGraph
from ..storage import keep
from . import traversal

BODIES = {
    "callees_of(of STRING) RETURNS TABLE(id STRING)": "SELECT dst FROM {name}_calls WHERE src = of",
    "callers_of(of STRING) RETURNS TABLE(id STRING)": "SELECT src FROM {name}_calls WHERE dst = of",
    "simple_paths(head STRING, tail STRING, most INT) RETURNS TABLE(path ARRAY<STRING>)": """
WITH RECURSIVE walk(way, at, n) AS (
  SELECT array(tail), tail, 0
  UNION ALL
  SELECT array_prepend(walk.way, src), src, walk.n + 1 FROM walk JOIN {name}_calls ON dst = walk.at
  WHERE walk.n + 1 < most AND walk.at <> head AND NOT array_contains(walk.way, src))
SELECT way FROM walk WHERE at = head AND n < most""",
}
WALKS = {
    "reachable_from(of STRING) RETURNS TABLE(id STRING, depth INT)": "SELECT id, depth FROM {name}_walks WHERE start = of AND forth",
    "can_reach(of STRING) RETURNS TABLE(id STRING, depth INT)": "SELECT id, depth FROM {name}_walks WHERE start = of AND NOT forth",
}


def register(g: CallGraph, name: str = "cg", starts: DataFrame | None = None) -> None:
    """Registers the graph in its session; calls are written once. starts(id) are walked from together, both ways, before this returns."""
    spark = g.functions.sparkSession
    g.functions.createOrReplaceTempView(f"{name}_functions")
    calls = keep(g.sites)
    calls.createOrReplaceTempView(f"{name}_calls")
    bodies = dict(BODIES)
    if starts is not None:
        starts = keep(starts.select("id").distinct())
        keep(g.functions.join(starts, "id", "left_semi").select(*g.functions.columns)).createOrReplaceTempView(f"{name}_starts")
        roads = traversal.Roads(calls.select("src", "dst"), once=True)
        forth, back = traversal.closures(roads, starts), traversal.closures(roads.back(), starts)
        forth.withColumn("forth", F.lit(True)).unionByName(back.withColumn("forth", F.lit(False))).createOrReplaceTempView(f"{name}_walks")
        bodies |= WALKS
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_{head} RETURN {body.format(name=name)}")
