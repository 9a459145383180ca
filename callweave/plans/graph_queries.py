"""Queries of filters, joins, traversals, paths, reports and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import symbol_id
from ..graph import CallGraph, distinct_calls, first_wins
from ..operators import filters, navigation, paths, reports, search, sql_functions, traversal
from .derived import line_graph, table_graph, transitions

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# Tables of the derived graphs, for the SQL.
LINES = """lf AS (SELECT p_partkey::BIGINT AS seq, p_partkey::VARCHAR AS id, p_name AS name, p_brand || '::' || p_name AS qualified_name, 'src/' || p_type || '.c' AS file_path, (p_partkey + 1)::INT AS line FROM part),
lk AS (SELECT l_orderkey, l_linenumber, l_partkey, lead(l_partkey) OVER w AS b, row_number() OVER w AS k FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
lc AS (SELECT (l_orderkey * 1000 + k)::BIGINT AS seq, l_partkey::VARCHAR AS caller, b::VARCHAR AS callee FROM lk WHERE b IS NOT NULL),
ld AS (SELECT user_id::VARCHAR AS id, CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS severity FROM events WHERE event_type <> 'purchase')"""
TABLES = """tf AS (SELECT 'R' || r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 'N' || n_nationkey, n_name FROM nation UNION ALL SELECT 'C' || c_custkey, c_name FROM customer
  UNION ALL SELECT 'O' || o_orderkey, 'Order#' || o_orderkey FROM orders UNION ALL SELECT 'P' || p_partkey, p_name FROM part),
tl AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem),
tc AS (SELECT n_nationkey::BIGINT AS seq, 'R' || n_regionkey AS caller, 'N' || n_nationkey AS callee FROM nation UNION ALL SELECT c_custkey, 'N' || c_nationkey, 'C' || c_custkey FROM customer
  UNION ALL SELECT s_suppkey + 1000000000000000, 'N' || s_nationkey, 'S' || s_suppkey FROM supplier UNION ALL SELECT o_orderkey, 'C' || o_custkey, 'O' || o_orderkey FROM orders
  UNION ALL SELECT l_orderkey * 1000 + k, 'O' || l_orderkey, 'P' || l_partkey FROM tl UNION ALL SELECT l_orderkey * 1000 + k + 1000000000000000, 'O' || l_orderkey, 'S' || l_suppkey FROM tl),
td AS (SELECT 'C' || user_id AS id, CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS severity FROM events WHERE event_type <> 'purchase')"""
DEGREES = """ti AS (SELECT callee AS id, count(*) AS n FROM tc WHERE caller IN (SELECT id FROM tf) GROUP BY 1), tu AS (SELECT caller AS id, count(*) AS n FROM tc WHERE callee IN (SELECT id FROM tf) GROUP BY 1),
tx AS (SELECT id, count(*) AS n_diagnostics, count(*) FILTER (severity = 1) AS n_errors, count(*) FILTER (severity = 2) AS n_warnings FROM td GROUP BY 1),
tn AS (SELECT tf.id, coalesce(ti.n, 0)::BIGINT AS n_callers, coalesce(tu.n, 0)::BIGINT AS n_callees, coalesce(n_diagnostics, 0) AS n_diagnostics, coalesce(n_errors, 0) AS n_errors, coalesce(n_warnings, 0) AS n_warnings
  FROM tf LEFT JOIN ti USING (id) LEFT JOIN tu USING (id) LEFT JOIN tx USING (id))"""


def closure(calls: str, start: str, src: str = "caller", dst: str = "callee") -> str:
    return f"r AS (SELECT '{start}' AS id UNION SELECT {dst} FROM r JOIN {calls} ON {src} = r.id)"


def depths(calls: str, start: str, most: int = 12) -> str:
    return f"r AS (SELECT '{start}' AS id, 0 AS depth UNION SELECT callee, depth + 1 FROM r JOIN (SELECT DISTINCT caller, callee FROM {calls}) ON caller = r.id WHERE depth < {most})"


#: All walks over the graph of tables, which has no cycles; of those to a node the shortest and first is the one a queue finds.
def walks(calls: str, start: str, most: int = 12) -> str:
    return (
        f"r AS (SELECT '{start}' AS id, ['{start}'] AS path, []::BIGINT[] AS ord UNION ALL SELECT callee, list_append(path, callee), list_append(ord, seq) FROM r JOIN {calls} ON caller = r.id WHERE len(ord) < {most}), "
        "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY len(ord), ord) AS k FROM r) WHERE k = 1)")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def lines_id(df: DataFrame) -> DataFrame:
    return df.select("id", "name", "qualified_name")


@query(f"WITH {TABLES}, {DEGREES} SELECT count(*)::BIGINT AS total_functions, (SELECT count(*) FROM tc)::BIGINT AS total_calls, count(*) FILTER (n_callers = 0)::BIGINT AS entry_points, count(*) FILTER (n_callees = 0)::BIGINT AS leaf_functions, count(*) FILTER (n_diagnostics > 0)::BIGINT AS with_diagnostics, (SELECT count(*) FROM tc) / count(*) AS avg_calls FROM tn")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.graph_stats(table_graph(spark, sf_dir))


@query(f"WITH {TABLES}, {DEGREES} SELECT id, name FROM tf JOIN tn USING (id) WHERE n_callers = 0")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.entry_points(table_graph(spark, sf_dir)).select("id", "name")


@query(f"WITH {TABLES}, {DEGREES} SELECT id, name FROM tf JOIN tn USING (id) WHERE n_callees = 0")
def leaf_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.leaves(table_graph(spark, sf_dir)).select("id", "name")


@query(f"WITH {LINES} SELECT lf.id, name, qualified_name FROM lc JOIN lf ON caller = lf.id WHERE callee = '0'")
def callers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_id(line_graph(spark, sf_dir).callers("0"))


@query(f"WITH {LINES} SELECT lf.id, name, qualified_name FROM lc JOIN lf ON callee = lf.id WHERE caller = '0'")
def callees_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_id(line_graph(spark, sf_dir).callees("0"))


@query(f"WITH {TABLES}, {DEGREES} SELECT id, n_callers, n_callees FROM tn")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_graph(spark, sf_dir).degrees()


@query(f"WITH {TABLES}, {DEGREES} SELECT id, n_callers + n_callees AS degree FROM tn WHERE n_callers + n_callees >= 5")
def highly_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.highly_connected(table_graph(spark, sf_dir), 5)


@query(f"WITH {LINES} SELECT id, name, qualified_name FROM lf WHERE contains(name, 'anv') OR contains(qualified_name, 'anv')")
def filter_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = line_graph(spark, sf_dir)
    return lines_id(filters.where(g, filters.name_contains("anv")))


@query(f"WITH {LINES} SELECT id, name, qualified_name FROM lf WHERE contains(file_path, 'ECONOMY')")
def filter_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_id(filters.where(line_graph(spark, sf_dir), filters.file_contains("ECONOMY")))


@query(f"WITH {LINES} SELECT id, name, qualified_name FROM lf WHERE (contains(name, 'anv') OR contains(qualified_name, 'anv')) AND contains(file_path, 'ECONOMY') AND line > 10")
def filter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = line_graph(spark, sf_dir)
    return lines_id(filters.where(g, filters.name_contains("anv"), filters.file_contains("ECONOMY"), F.col("definition_location.line") > 10))


@query(f"WITH {LINES} SELECT id, name, qualified_name FROM lf WHERE id IN (SELECT id FROM ld WHERE severity = 1)")
def severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_id(filters.with_severity(line_graph(spark, sf_dir), 1))


@query(f"WITH {LINES} SELECT id, name, qualified_name FROM lf WHERE id IN (SELECT id FROM ld)")
def with_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_id(filters.with_diagnostics(line_graph(spark, sf_dir)))


@query(f"WITH {LINES} SELECT id, name, qualified_name FROM lf WHERE id IN (SELECT l_partkey::VARCHAR FROM lineitem GROUP BY 1 HAVING count(*) >= 30)")
def ref_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_id(filters.with_references(line_graph(spark, sf_dir), 30))


@query("SELECT l_partkey::VARCHAR AS function_id, 'Supplier#' || l_suppkey AS name, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL")
def calling_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_graph(spark, sf_dir).calling_symbols().groupBy("function_id", "name").agg(F.count("*").alias("n"))


@query("SELECT l_partkey::VARCHAR AS function_id, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
def symbols_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_graph(spark, sf_dir).symbols_of_kind("Variable").groupBy("function_id").agg(F.count("*").alias("n"))


@query("SELECT l_partkey::VARCHAR AS function_id, 'order/' || l_orderkey AS file_path, l_linenumber::INT AS line, 1::INT AS \"column\" FROM lineitem")
def reference_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_graph(spark, sf_dir).reference_locations().select("function_id", "file_path", "line", "column")


@query(f"WITH {LINES} SELECT id, name, qualified_name FROM lf WHERE name = (SELECT min(name) FROM lf) ORDER BY seq LIMIT 1")
def find_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = line_graph(spark, sf_dir)
    return lines_id(g.function_by_name(g.functions.agg(F.min("name")).first()[0]))


@query(f"WITH {LINES} SELECT name, min(seq)::BIGINT AS seq FROM lf GROUP BY name")
def name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_wins(line_graph(spark, sf_dir).functions.select("name", "seq", "id"), ["name"]).select("name", "seq")


@query(f"""WITH {LINES}, h AS (SELECT id, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(qualified_name || '@' || file_path || ':' || line)) AS h FROM lf)
SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS symbol_id FROM h""")
def symbol_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("definition_location")
    return line_graph(spark, sf_dir).functions.select("id", symbol_id(F.col("qualified_name"), at["file_path"], at["line"]).alias("symbol_id"))


@query(f"WITH {LINES} SELECT caller, callee, count(*)::BIGINT AS n FROM lc GROUP BY ALL")
def edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = line_graph(spark, sf_dir).calls
    return distinct_calls(calls.unionByName(calls)).groupBy("caller", "callee").agg(F.count("*").alias("n"))


@query(f"WITH {TABLES} SELECT caller, callee, seq FROM tc WHERE callee IN (SELECT id FROM tf) AND caller IN (SELECT id FROM tf)")
def resolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_graph(spark, sf_dir).resolved_calls.select("caller", "callee", "seq")


@query(f"WITH RECURSIVE {LINES}, {closure('lc', '0')} SELECT id FROM r")
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.reachable(line_graph(spark, sf_dir).sites, "0")


@query(f"WITH RECURSIVE {TABLES}, {closure('tc', 'P0', 'callee', 'caller')} SELECT id FROM r")
def can_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.reachable(table_graph(spark, sf_dir).reversed_sites, "P0")


@query(f"WITH RECURSIVE {LINES}, {depths('lc', '0', 2)} SELECT id FROM r GROUP BY id HAVING min(depth) = 2")
def at_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.at_depth(line_graph(spark, sf_dir).sites, "0", 2)


@query(f"WITH RECURSIVE {LINES}, {depths('lc', '0')} SELECT id, min(depth)::INT AS depth FROM r GROUP BY id")
def call_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions reachable from the first part, and in how many calls."""
    return traversal.call_depth(line_graph(spark, sf_dir).sites, "0")


@query(f"WITH RECURSIVE {TABLES}, {walks('tc', 'R0')} SELECT array_to_string(path, '>') AS path FROM best WHERE id = 'P0'")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.shortest_path(table_graph(spark, sf_dir).sites, "R0", "P0").select(F.array_join("path", ">").alias("path"))


@query(f"WITH RECURSIVE {TABLES}, {walks('tc', 'R0')} SELECT id, array_to_string(path, '>') AS path FROM best")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.shortest_paths(table_graph(spark, sf_dir).sites, "R0").select("id", F.array_join("path", ">").alias("path"))


@query(f"WITH RECURSIVE {TABLES}, {walks('tc', 'R0', 4)} SELECT array_to_string(path, '>') AS path FROM r WHERE id = 'P0'")
def all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table_graph(spark, sf_dir)
    return paths.all_paths(g.sites, "R0", "P0", 5).select(F.array_join("path", ">").alias("path"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT * FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL),
r AS (SELECT ['click'] AS path, 'click' AS last UNION ALL SELECT list_append(path, dst), dst FROM r JOIN e ON src = last WHERE NOT list_contains(path, dst) AND len(path) < 5)
SELECT array_to_string(list_append(path[list_position(path, dst):], dst), '>') AS cycle FROM r JOIN e ON src = last WHERE list_contains(path, dst)""")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.cycles(transitions(spark, sf_dir), "click", 5).select(F.array_join("cycle", ">").alias("cycle"))


@query(f"WITH RECURSIVE {LINES}, {depths('lc', '0')}, d AS (SELECT id, min(depth) AS depth FROM r GROUP BY id) SELECT count(*)::BIGINT AS total_paths, max(depth)::BIGINT AS max_depth, avg(depth)::DOUBLE AS avg_depth FROM d")
def path_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.path_analysis(line_graph(spark, sf_dir).sites, "0")


@query(f"""WITH RECURSIVE {TABLES}, {DEGREES}, {closure('tc', 'N0')}, u AS (SELECT 'N0' AS id UNION SELECT caller FROM u JOIN tc ON callee = u.id)
SELECT tf.id, name, 'nation::' || name AS qualified_name, n_callers, n_callees, (SELECT count(*) FROM r)::BIGINT AS n_reachable, (SELECT count(*) FROM u)::BIGINT AS n_can_reach, n_diagnostics > 0 AS has_diagnostics, n_errors::BIGINT AS n_errors, n_warnings::BIGINT AS n_warnings
FROM tf JOIN tn USING (id) WHERE tf.id = 'N0'""")
def function_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.function_info(table_graph(spark, sf_dir), "N0")


@query(f"""WITH RECURSIVE {TABLES}, u AS (SELECT 'P0' AS id UNION SELECT caller FROM u JOIN tc ON callee = u.id)
SELECT (SELECT count(*) FROM tc JOIN tf ON caller = tf.id WHERE callee = 'P0')::BIGINT AS direct, (SELECT count(*) FROM u)::BIGINT AS total, 5::BIGINT AS max_depth""")
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.impact(table_graph(spark, sf_dir), "P0", 5)[0]


@query(f"WITH RECURSIVE {TABLES}, u AS (SELECT 'P0' AS id, 0 AS depth UNION SELECT caller, depth + 1 FROM u JOIN tc ON callee = u.id) SELECT id, min(depth)::INT AS depth FROM u GROUP BY id")
def impact_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.impact(table_graph(spark, sf_dir), "P0", 5)[2]


@query(f"""WITH RECURSIVE {TABLES}, {walks('tc', 'R0')}
SELECT (SELECT count(*) FROM tc JOIN tf ON callee = tf.id WHERE caller = 'R0')::BIGINT AS direct, count(*)::BIGINT AS total, count(*)::BIGINT AS total_paths, max(len(ord))::BIGINT AS max_depth, avg(len(ord))::DOUBLE AS avg_depth, 5::BIGINT AS depth_limit FROM best""")
def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dependencies(table_graph(spark, sf_dir), "R0", 5)


@query(f"""WITH {TABLES}, {DEGREES} SELECT 'error' AS area, id FROM tn WHERE n_errors > 0 UNION ALL SELECT 'warning', id FROM tn WHERE n_warnings > 0 UNION ALL SELECT 'highly_connected', id FROM tn WHERE n_callers + n_callees >= 5""")
def problem_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.problem_areas(table_graph(spark, sf_dir))


@query(f"""WITH {TABLES}, {DEGREES} SELECT count(*) FILTER (n_errors > 0)::BIGINT AS errors, count(*) FILTER (n_warnings > 0)::BIGINT AS warnings, count(*) FILTER (n_callers + n_callees >= 5)::BIGINT AS highly_connected,
count(*) FILTER (n_callers = 0)::BIGINT AS entry_points, count(*) FILTER (n_callees = 0)::BIGINT AS leaf_functions FROM tn""")
def problem_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.problem_counts(table_graph(spark, sf_dir))


@query(f"WITH {LINES} SELECT id, name FROM lf WHERE contains(name, 'EC') OR contains(qualified_name, 'EC') OR contains(file_path, 'EC') ORDER BY name, id")
def search_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.search_functions(line_graph(spark, sf_dir), "EC").select("id", "name")


def _found(column: str, pattern: str) -> str:
    return f"WITH {LINES} SELECT id, name, file_path, line, 1::FLOAT AS score FROM lf WHERE contains(lower({column}), '{pattern}') ORDER BY name, id LIMIT 50"


@query(_found("name", "an"))
def search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(line_graph(spark, sf_dir), "AN", "exact")


@query(_found("file_path", "economy"))
def search_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(line_graph(spark, sf_dir), "economy", "path")


@query(f"WITH {LINES} SELECT id, name, file_path, line, 1::FLOAT AS score FROM lf ORDER BY name, id LIMIT 50")
def search_everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(line_graph(spark, sf_dir), "")


@query("""SELECT * FROM (SELECT p_partkey::VARCHAR AS id, p_name AS name, 'src/' || p_type || '.c' AS file_path, (p_partkey + 1)::INT AS line, (1.0::DOUBLE / greatest(log2(a), 1.0) * (1.0::DOUBLE / (c - a + 1)))::FLOAT AS score
FROM (SELECT *, b + instr(substr(t, b + 1), 'n') AS c FROM (SELECT *, a + instr(substr(t, a + 1), 'a') AS b FROM (SELECT *, lower(p_name) AS t, instr(lower(p_name), 'b') AS a FROM part))) WHERE a > 0 AND b > a AND c > b)
ORDER BY score DESC, name, id LIMIT 50""")
def search_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(line_graph(spark, sf_dir), "ban")


def _view(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g: CallGraph = table_graph(spark, sf_dir)
    return traversal.dag(g.sites, g.functions.select("id"), "N0", 3)


NODES = f"{TABLES}, tk AS (SELECT * FROM tc WHERE callee IN (SELECT id FROM tf)), {walks('tk', 'N0', 3)}, nodes AS (SELECT row_number() OVER (ORDER BY len(ord), ord) - 1 AS idx, id, len(ord)::INT AS depth FROM best)"


@query(f"WITH RECURSIVE {NODES} SELECT idx::BIGINT AS idx, id, depth FROM nodes")
def dag_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir)[0]


@query(f"WITH RECURSIVE {NODES} SELECT s.idx::BIGINT AS src, t.idx::BIGINT AS dst, tk.seq AS ord FROM tk JOIN nodes s ON caller = s.id JOIN nodes t ON callee = t.id WHERE s.depth < 3")
def dag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir)[1]


@query(f"WITH {TABLES} SELECT id FROM tf WHERE id NOT IN (SELECT callee FROM tc)")
def dag_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table_graph(spark, sf_dir)
    return traversal.roots(g.functions.select(F.col("id").alias("idx")), g.edges).withColumnRenamed("idx", "id")


def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_graph(spark, sf_dir).sites.withColumnRenamed("seq", "ord")


@query(f"""WITH {TABLES} SELECT caller AS parent, callee AS idx, seq AS ord, coalesce(lead(callee) OVER w, first_value(callee) OVER w) AS next,
coalesce(lag(callee) OVER w, last_value(callee) OVER (PARTITION BY caller ORDER BY seq, callee ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous FROM tc WINDOW w AS (PARTITION BY caller ORDER BY seq, callee)""")
def siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.siblings(_children(spark, sf_dir))


@query(f"""WITH {TABLES}, k AS (SELECT caller, callee, row_number() OVER (PARTITION BY caller ORDER BY seq, callee) - 1 AS k, count(*) OVER (PARTITION BY caller) AS n FROM tc) SELECT caller AS parent, callee AS child FROM k WHERE k = (n - 1) // 2""")
def middle_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.middle_children(_children(spark, sf_dir))


@query(f"""WITH {TABLES}, k AS (SELECT caller, callee, row_number() OVER (PARTITION BY callee ORDER BY caller, seq) - 1 AS k, count(*) OVER (PARTITION BY callee) AS n FROM tc) SELECT callee AS idx, caller AS parent FROM k WHERE k = 7 % n""")
def active_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.active_parents(_children(spark, sf_dir), 7)


@query(f"WITH RECURSIVE {TABLES}, {walks('tc', 'N0', 4)} SELECT array_to_string(path, '>') AS path FROM r WHERE id = 'P0'")
def sql_simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths by the table function: from the first nation to the first part, which it walks back from."""
    sql_functions.register(table_graph(spark, sf_dir), "simple")
    return spark.sql("SELECT array_join(path, '>') AS path FROM simple_simple_paths('N0', 'P0', 5)")


@query(f"""WITH RECURSIVE {TABLES}, ts AS (SELECT DISTINCT caller, callee FROM tc), w AS (SELECT id AS start, id, 0 AS depth FROM tf WHERE id LIKE 'N%' UNION SELECT start, callee, depth + 1 FROM w JOIN ts ON caller = w.id),
m AS (SELECT start, id, min(depth) AS depth FROM w GROUP BY ALL) SELECT name, count(*)::BIGINT AS n_reachable, max(depth)::INT AS max_depth FROM m JOIN tf ON tf.id = start GROUP BY name""")
def sql_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each nation reaches, by a lateral table function over walks from all of them."""
    g = table_graph(spark, sf_dir)
    sql_functions.register(g, "nations", g.functions.filter(F.startswith("id", F.lit("N"))).select("id"))
    return spark.sql("SELECT f.name, count(*) AS n_reachable, max(r.depth) AS max_depth FROM nations_starts f, LATERAL nations_reachable_from(f.id) r GROUP BY f.name")
