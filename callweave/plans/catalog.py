"""Queries over the derived call graphs, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import graph_queries, layout_queries, source_queries

QUERIES = graph_queries.QUERIES | layout_queries.QUERIES | source_queries.QUERIES
ORACLE_SQL = graph_queries.ORACLE_SQL | layout_queries.ORACLE_SQL | source_queries.ORACLE_SQL
