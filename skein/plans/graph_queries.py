"""Overviews, descriptions, join paths and traversals, over the catalogue and over a graph of rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.model import Graph, age, dedupe_edges, dialect, short_id
from skein.operators import diff, joins, paths, report, scan, text
from skein.plans.registry import query, table
from skein.sources import catalog

NAMES = ", ".join(f"'{t}'" for t in catalog.TABLES)
FK = "fk(src, fc, dst, tc, ord) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}', {i})" for i, (a, b, c, d) in enumerate(catalog.KEYS)) + ")"
WALK = f"""WITH RECURSIVE {FK},
u AS (SELECT src a, dst b, fc ca, tc cb FROM fk UNION ALL SELECT dst, src, tc, fc FROM fk WHERE src <> dst),
deg AS (SELECT a, count(*) d FROM u GROUP BY a),
walk(start, place, seen, ca, cb, hops, cost) AS (
  SELECT a, a, [a], []::VARCHAR[], []::VARCHAR[], 0, 0 FROM deg
  UNION ALL
  SELECT w.start, u.b, list_append(w.seen, u.b), list_append(w.ca, u.ca), list_append(w.cb, u.cb), w.hops + 1, w.cost + 1 + CASE WHEN w.hops > 0 THEN deg.d ELSE 0 END
  FROM walk w JOIN u ON u.a = w.place JOIN deg ON deg.a = w.place WHERE NOT list_contains(w.seen, u.b)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start, place ORDER BY cost, seen) n FROM walk WHERE hops > 0) WHERE n = 1)"""
#: The graph of rows: who references whom, and which order contains which part and supplier.
ROWS_SQL = """e AS (
  SELECT 'nation:' || n_nationkey src, 'region:' || n_regionkey dst, 'REFERENCES' AS type, n_nationkey::BIGINT ord FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'REFERENCES', 1000 + s_suppkey FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'REFERENCES', 100000000 + c_custkey FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'REFERENCES', 10000000000 + o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'CONTAINS', 1000000000000 + l_orderkey * 100000 + l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'CONTAINS', 1000000000000000000 + l_orderkey * 100000 + l_suppkey FROM lineitem)"""


def row_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def link(name: str, a: str, ka: str, b: str, kb: str, kind: str, ord_: str, distinct: bool = False) -> DataFrame:
        rows = table(spark, sf_dir, name).selectExpr(f"concat('{a}:', {ka}) AS src", f"concat('{b}:', {kb}) AS dst", f"'{kind}' AS type", f"CAST({ord_} AS BIGINT) AS ord")
        return rows.distinct() if distinct else rows

    return (
        link("nation", "nation", "n_nationkey", "region", "n_regionkey", "REFERENCES", "n_nationkey")
        .unionByName(link("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "REFERENCES", "1000 + s_suppkey"))
        .unionByName(link("customer", "customer", "c_custkey", "nation", "c_nationkey", "REFERENCES", "100000000 + c_custkey"))
        .unionByName(link("orders", "order", "o_orderkey", "customer", "o_custkey", "REFERENCES", "10000000000 + o_orderkey"))
        .unionByName(link("lineitem", "order", "l_orderkey", "part", "l_partkey", "CONTAINS", "1000000000000L + l_orderkey * 100000 + l_partkey", True))
        .unionByName(link("lineitem", "order", "l_orderkey", "supplier", "l_suppkey", "CONTAINS", "1000000000000000000L + l_orderkey * 100000 + l_suppkey", True))
    )


@query(f"""SELECT 'database' AS type, 1::BIGINT AS n UNION ALL SELECT 'table', count(DISTINCT table_name) FROM information_schema.columns WHERE table_name IN ({NAMES})
UNION ALL SELECT 'column', count(*) FROM information_schema.columns WHERE table_name IN ({NAMES})""")
def overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.overview_counts(catalog.extract(spark, sf_dir).nodes)


@query(f"""WITH {FK}, rows AS ({" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS row_count FROM {t}" for t in catalog.TABLES)}),
cols AS (SELECT table_name AS name, count(*) AS columns FROM information_schema.columns WHERE table_name IN ({NAMES}) GROUP BY 1),
refs AS (SELECT src AS name, string_agg(dst, ', ' ORDER BY ord) AS refs FROM fk GROUP BY 1)
SELECT name, row_count, columns, coalesce(refs, '') AS refs FROM rows JOIN cols USING (name) LEFT JOIN refs USING (name)""")
def overview_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.overview_tables(catalog.extract(spark, sf_dir))


@query(f"""WITH {FK} SELECT 'HAS_TABLE' AS type, 'database' AS other, 'in' AS dir
UNION ALL SELECT 'HAS_COLUMN', 'column:orders.' || column_name, 'out' FROM information_schema.columns WHERE table_name = 'orders'
UNION ALL SELECT 'REFERENCES', 'table:' || dst, 'out' FROM fk WHERE src = 'orders' UNION ALL SELECT 'REFERENCES', 'table:' || src, 'in' FROM fk WHERE dst = 'orders'""")
def describe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.describe(catalog.extract(spark, sf_dir), "orders")
    return found.select("type", F.when(F.col("other").startswith("database:"), "database").otherwise(F.col("other")).alias("other"), "dir")


@query("""WITH e AS (SELECT n_nationkey::VARCHAR src, n_regionkey::VARCHAR dst FROM nation), u AS (SELECT src id FROM e UNION ALL SELECT dst FROM e WHERE src <> dst)
SELECT id, count(*) AS degree FROM u GROUP BY id""")
def edges_self_loop_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.degrees(table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS STRING) AS src", "CAST(n_regionkey AS STRING) AS dst"))


@query(WALK + """ SELECT i::INT AS step, seen[i] AS from_table, seen[i + 1] AS to_table, ca[i] AS from_column, cb[i] AS to_column
FROM best, range(1, 100) r(i) WHERE start = 'customer' AND place = 'part' AND i <= hops""")
def join_path_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join_path(catalog.extract(spark, sf_dir, counts=False), "customer", "part")


@query(WALK + """ SELECT DISTINCT CASE WHEN l < r THEN l || ' = ' || r ELSE r || ' = ' || l END AS cond
FROM (SELECT seen[i] || '.' || ca[i] AS l, seen[i + 1] || '.' || cb[i] AS r FROM best, range(1, 100) x(i)
WHERE start IN ('customer', 'lineitem', 'nation', 'orders') AND place IN ('customer', 'lineitem', 'nation', 'orders') AND start < place AND hops <= 3 AND i <= hops)""")
def join_pairs_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join_conditions(catalog.extract(spark, sf_dir, counts=False), list(combinations(("customer", "lineitem", "nation", "orders"), 2)))


@query(f"""WITH RECURSIVE {ROWS_SQL}, u AS (SELECT src a, dst b FROM e UNION SELECT dst, src FROM e),
bfs(id, level) USING KEY (id) AS (SELECT 'region:0', 0 UNION SELECT u.b, bfs.level + 1 FROM bfs JOIN u ON u.a = bfs.id WHERE bfs.level < 6 AND u.b NOT IN (SELECT id FROM recurring.bfs))
SELECT level AS hops, level AS linked FROM bfs WHERE id = 'part:1'""")
def shortest_path_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many hops the path has, and how many of them are edges."""
    edges = row_edges(spark, sf_dir)
    path = paths.shortest_path(edges, "region:0", "part:1")
    hops = spark.createDataFrame(list(zip(path, path[1:], strict=False)), "a string, b string")
    linked = edges.join(F.broadcast(hops), F.expr("src = a AND dst = b OR src = b AND dst = a")).select("a", "b").distinct()
    return linked.agg(F.lit(len(path) - 1).alias("hops"), F.count("*").cast("int").alias("linked"))


def region_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.impact(row_edges(spark, sf_dir), "region:0", 3, ("REFERENCES",))


REGION = f"""WITH {ROWS_SQL}, l1 AS (SELECT DISTINCT src id FROM e WHERE dst = 'region:0' AND type = 'REFERENCES'),
l2 AS (SELECT DISTINCT src id FROM e JOIN l1 ON dst = id WHERE type = 'REFERENCES'), l3 AS (SELECT DISTINCT src id FROM e JOIN l2 ON dst = id WHERE type = 'REFERENCES'),
l AS (SELECT id, 1 AS level FROM l1 UNION ALL SELECT id, 2 FROM l2 UNION ALL SELECT id, 3 FROM l3)"""


@query(REGION + " SELECT level, count(*) AS n FROM l GROUP BY level")
def impact_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_levels(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"))


@query(REGION + """ SELECT id, level, more FROM (SELECT id, level, row_number() OVER (PARTITION BY level ORDER BY id) n, greatest(count(*) OVER (PARTITION BY level) - 25, 0) AS more FROM l) WHERE n <= 25""")
def impact_level_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.capped(region_levels(spark, sf_dir), "level", ["id"]).select("id", "level", "more")


@query(f"""WITH {ROWS_SQL}, b AS (SELECT * FROM e WHERE type IN ('REFERENCES', 'CONTAINS')),
one AS (SELECT id, type, ord AS place FROM (SELECT src id, type, ord, row_number() OVER (PARTITION BY src ORDER BY ord, type) n FROM b WHERE dst = 'nation:0') WHERE n = 1),
two AS (SELECT id, type FROM (SELECT b.src id, b.type, row_number() OVER (PARTITION BY b.src ORDER BY one.place, b.ord, b.type) n FROM b JOIN one ON b.dst = one.id
  WHERE b.src <> 'nation:0' AND b.src NOT IN (SELECT id FROM one)) WHERE n = 1)
SELECT level, type, count(*) AS n FROM (SELECT 1 AS level, type FROM one UNION ALL SELECT 2, type FROM two) GROUP BY 1, 2""")
def blast_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paths.blast(row_edges(spark, sf_dir), spark.createDataFrame([("nation:0",)], "id string"), 2, ("REFERENCES", "CONTAINS"))
    return found.groupBy("level", "type").agg(F.count("*").alias("n"))


@query("""SELECT src, dst, type, min(ord)::BIGINT AS ord FROM (SELECT l_orderkey::VARCHAR src, l_suppkey::VARCHAR dst, l_returnflag AS type, l_partkey AS ord FROM lineitem) GROUP BY 1, 2, 3""")
def edge_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").selectExpr("CAST(l_orderkey AS STRING) AS src", "CAST(l_suppkey AS STRING) AS dst", "l_returnflag AS type", "l_partkey AS ord")
    return dedupe_edges(edges)


NOW = "2024-02-01 00:00:00"


@query(f"""SELECT 'postgresql' AS dialect, age, count(*) AS n FROM (SELECT CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS age
FROM (SELECT epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(ts))::BIGINT AS s FROM events)) GROUP BY age""")
def dialect_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    aged = table(spark, sf_dir, "events").select(age(at, F.lit(NOW).cast("timestamp")).alias("age"), dialect(F.lit("postgres:app")).alias("dialect"))
    return aged.groupBy("dialect", "age").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT 'customer.c_mktsegment' AS col, c_mktsegment AS v FROM customer UNION SELECT 'orders.o_orderstatus', o_orderstatus FROM orders UNION SELECT 'orders.o_orderpriority', o_orderpriority FROM orders
UNION SELECT 'lineitem.l_returnflag', l_returnflag FROM lineitem UNION SELECT 'part.p_type', p_type FROM part UNION SELECT 'part.p_name', p_name FROM part UNION SELECT 'events.event_type', event_type FROM events)
SELECT col, string_agg(v, ', ' ORDER BY v) AS enum_values FROM v GROUP BY col HAVING count(*) <= 20""")
def enum_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"customer": ["c_mktsegment"], "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag"], "part": ["p_type", "p_name"], "events": ["event_type"]}
    return joins.value_domains({t: table(spark, sf_dir, t) for t in columns}, columns, 20)


@query("""SELECT doc_id, used FROM (SELECT doc_id, coalesce(sum(octet_length(encode(text))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM documents) WHERE used <= 16384""")
def context_budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    return scan.budget_cut(docs, "size", ["doc_id"], 16384).select("doc_id", "used")


@query("""SELECT id, attrs FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'entity_note=late;status=' || CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END ELSE 'status=' || o_orderstatus END AS attrs FROM orders)""")
def annotate_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    nodes = orders.selectExpr("CAST(o_orderkey AS STRING) AS id", "'order' AS type", "'' AS name", "map('status', o_orderstatus) AS attrs")
    notes = orders.where("o_orderkey % 5 = 0").selectExpr("CAST(o_orderkey AS STRING) AS id", "IF(o_orderkey % 2 = 0, map('status', 'X', 'entity_note', 'late'), map('entity_note', 'late')) AS attrs")
    found = joins.annotated(nodes, notes.unionByName(spark.createDataFrame([("none", {"a": "b"})], notes.schema)))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return found.select(F.col("id").cast("long").alias("id"), shown.alias("attrs"))


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 3 = 0""")
def orphan_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return diff.orphan_annotations(ids.where("id % 7 = 0").unionByName(spark.range(-5, 0)), ids, ids.where("id % 3 <> 0"))


def code_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts as routes and as models, their types as handlers, suppliers as middleware and callers."""
    none = F.create_map().cast("map<string,string>")
    attrs = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))])
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_linenumber").cast("long").alias("line"))
    key = lambda c, p: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = part.select(key("p_partkey", "route:").alias("id"), F.lit("route").alias("type"), "p_name", attrs(file=F.col("p_brand"), line_start=F.col("p_size"), method=F.when(F.col("p_size") % 2 == 0, "GET").otherwise(""), path=key("p_partkey", "/p/")).alias("attrs"))
    renamed = F.concat_ws(", ", F.lit("id"), F.concat("p_name", F.lit("→"), F.col("p_size").cast("string")), F.concat("p_type", F.lit("→kind")))
    nodes = nodes.union(part.select(key("p_partkey", "model:"), F.lit("model"), F.concat("p_name", F.lit(" "), "p_partkey"), attrs(file=F.col("p_brand"), table=F.col("p_type"), field_count=F.col("p_size"), fields=renamed)))
    nodes = nodes.union(part.select("p_type").distinct().select(key("p_type", "func:"), F.lit("function"), "p_type", none))
    nodes = nodes.union(table(spark, sf_dir, "supplier").select(key("s_suppkey", "func:s"), F.lit("function"), "s_name", attrs(file=F.concat(F.lit("s"), F.col("s_nationkey").cast("string")))))
    edges = part.select(key("p_partkey", "route:").alias("src"), key("p_type", "func:").alias("dst"), F.lit("HANDLED_BY").alias("type"), none.alias("attrs"), F.col("p_partkey").cast("long").alias("ord"))
    edges = edges.union(lines.select(key("l_partkey", "route:"), key("l_suppkey", "func:s"), F.lit("USES_MIDDLEWARE"), attrs(order=F.col("line")), F.col("l_suppkey")))
    edges = edges.union(lines.select(key("l_suppkey", "func:s"), key("l_partkey", "route:"), F.lit("CALLS_ENDPOINT"), attrs(line=F.col("line")), F.col("l_suppkey")))
    edges = edges.union(lines.where("line > 3").select(key("l_partkey", "model:"), key("l_suppkey", "func:s"), F.lit("REFERENCES"), attrs(kind=F.concat(F.lit("has"), F.col("line").cast("string"))), F.col("l_suppkey")))
    return Graph(nodes.toDF("id", "type", "name", "attrs"), edges, "codebase:tables")


LINES_SQL = "li AS (SELECT l_partkey, l_suppkey, min(l_linenumber) AS line FROM lineitem GROUP BY 1, 2), s AS (SELECT l_partkey, l_suppkey, line, s_name, 's' || s_nationkey AS file FROM li JOIN supplier ON s_suppkey = l_suppkey)"


@query(f"""WITH {LINES_SQL}, m AS (SELECT l_partkey, string_agg(s_name, ', ' ORDER BY line, l_suppkey) AS middleware, list_sort(list(DISTINCT s_name || ' (' || file || ':' || line || ')')) AS c FROM s GROUP BY 1)
SELECT p_brand AS file, p_size AS line, CASE WHEN p_size % 2 = 0 THEN 'GET' ELSE 'ANY' END AS method, '/p/' || p_partkey AS path, p_type AS handler, coalesce(middleware, '') AS middleware, '' AS models,
coalesce(array_to_string(c[1:6], ', ') || CASE WHEN len(c) > 6 THEN ' … +' || (len(c) - 6) || ' more' ELSE '' END, '') AS callers FROM part LEFT JOIN m ON l_partkey = p_partkey""")
def routes_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.routes(code_graph(spark, sf_dir)).withColumn("middleware", F.coalesce("middleware", F.lit("")))


@query(f"""WITH {LINES_SQL}, m AS (SELECT l_partkey, list_sort(list('has' || line || ' ' || s_name)) AS c FROM s WHERE line > 3 GROUP BY 1)
SELECT p_brand AS file, p_name || ' ' || p_partkey AS name, p_type AS "table", p_size AS field_count, p_name || '→' || p_size || ', ' || p_type || '→kind' AS renamed,
coalesce(array_to_string(c[1:10], ', ') || CASE WHEN len(c) > 10 THEN ' … +' || (len(c) - 10) || ' more' ELSE '' END, '') AS associations FROM part LEFT JOIN m ON l_partkey = p_partkey""")
def models_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.models(code_graph(spark, sf_dir))


@query("""WITH li AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT p_partkey AS id, 'route ' || p_name || '.' AS head FROM part""")
def route_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.node_texts(code_graph(spark, sf_dir)).where("type = 'route'")
    return found.select(F.substring("id", 7, 99).cast("long").alias("id"), F.regexp_extract("text", r"^([^.]*[.])", 1).alias("head"))


@query("""SELECT n_regionkey::VARCHAR AS type, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS place FROM nation""")
def nodes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every type's nodes in the order of names."""
    nation = table(spark, sf_dir, "nation").selectExpr("concat('nation:', n_nationkey) AS id", "CAST(n_regionkey AS STRING) AS type", "n_name AS name", "CAST(map() AS map<string,string>) AS attrs")
    graph = Graph(nation, spark.createDataFrame([], "src string, dst string, type string, attrs map<string,string>, ord bigint"))
    out = None
    for kind in sorted(r.type for r in nation.select("type").distinct().collect()):
        rows = [(kind, r.name, i) for i, r in enumerate(graph.nodes_by_type(kind).collect(), 1)]
        part = spark.createDataFrame(rows, "type string, name string, place long")
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH gone AS (SELECT s_suppkey AS id FROM supplier WHERE s_acctbal < 0) SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey NOT IN (SELECT id FROM gone) AND l_suppkey IN (SELECT s_suppkey FROM supplier)""")
def remove_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that are left when the suppliers in debt are removed."""
    supplier = table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) AS id", "'supplier' AS type", "s_name AS name", "map('balance', CAST(s_acctbal AS STRING)) AS attrs")
    edges = table(spark, sf_dir, "lineitem").selectExpr("concat('s', l_suppkey) AS src", "concat('p', l_partkey) AS dst", "'SUPPLIES' AS type", "CAST(map() AS map<string,string>) AS attrs", "l_orderkey AS ord")
    left = Graph(supplier, edges).remove_nodes_where(F.col("attrs")["balance"].cast("double") < 0)
    return left.edges.select(F.substring("src", 2, 99).cast("long").alias("src"), F.substring("dst", 2, 99).cast("long").alias("dst"))


@query("""SELECT 'public.' || p_name AS id, p_name AS short FROM part UNION ALL SELECT 'column:public.orders.' || p_type, 'orders.' || p_type FROM part UNION ALL SELECT 'endpoint:GET /' || p_partkey, 'GET /' || p_partkey FROM part""")
def short_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.explode(F.array(F.concat(F.lit("public."), "p_name"), F.concat(F.lit("column:public.orders."), "p_type"), F.concat(F.lit("endpoint:GET /"), F.col("p_partkey").cast("string"))))
    return table(spark, sf_dir, "part").select(ids.alias("id")).select("id", short_id(F.col("id")).alias("short"))
