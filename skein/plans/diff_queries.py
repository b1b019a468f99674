"""Differences and drift, between snapshots made of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.model import Graph
from skein.operators import diff
from skein.plans.registry import query, table


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    row = "CAST(o_orderkey AS STRING) AS id", "'order' AS type", "'' AS name"
    old = orders.where("o_orderkey % 10 <> 1").selectExpr(*row, "map('status', o_orderstatus, 'priority', o_orderpriority) AS attrs")
    new = orders.where("o_orderkey % 10 <> 2").selectExpr(*row, "CASE o_orderkey % 10 WHEN 3 THEN map('status', 'X', 'priority', o_orderpriority) WHEN 4 THEN map('status', o_orderstatus, 'priority', o_orderpriority, 'note', 'n') WHEN 5 THEN map('status', o_orderstatus) ELSE map('priority', o_orderpriority, 'status', o_orderstatus) END AS attrs")
    return old, new


@query("""SELECT o_orderkey::VARCHAR AS id, CASE o_orderkey % 10 WHEN 1 THEN 'added' WHEN 2 THEN 'removed' ELSE 'changed' END AS change,
CASE o_orderkey % 10 WHEN 3 THEN 'status: ' || o_orderstatus || ' → X' WHEN 4 THEN '+note' WHEN 5 THEN '-priority' END AS notes FROM orders WHERE o_orderkey % 10 IN (1, 2, 4, 5) OR (o_orderkey % 10 = 3 AND o_orderstatus <> 'X')""")
def graph_diff_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diff.diff_nodes(*snapshots(spark, sf_dir))
    return found.select("id", "change", F.array_join("notes", "; ").alias("notes"))


@query("""WITH a AS (SELECT l_orderkey s, l_suppkey d, l_returnflag t, l_linestatus k FROM lineitem WHERE l_linenumber <> 1), b AS (SELECT l_orderkey s, l_suppkey d, l_returnflag t, CASE WHEN l_linenumber = 3 THEN 'Z' ELSE l_linestatus END k FROM lineitem WHERE l_linenumber <> 2),
n AS (SELECT s, d, t, k, sum(m)::BIGINT m FROM (SELECT *, -1 m FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY 1, 2, 3, 4)
SELECT t AS type, sum(greatest(m, 0))::BIGINT AS added, sum(greatest(-m, 0))::BIGINT AS removed FROM n GROUP BY t HAVING sum(abs(m)) > 0""")
def graph_diff_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").selectExpr("CAST(l_orderkey AS STRING) AS src", "CAST(l_suppkey AS STRING) AS dst", "l_returnflag AS type", "l_linestatus AS k", "l_linenumber AS n")
    old = edges.where("n <> 1").selectExpr("src", "dst", "type", "map('k', k) AS attrs")
    return diff.diff_edges(old, edges.where("n <> 2").selectExpr("src", "dst", "type", "map('k', IF(n = 3, 'Z', k)) AS attrs"))


@query("""SELECT CASE WHEN p_partkey % 10 = 1 THEN 'changed' WHEN p_partkey % 10 = 2 THEN 'renamed' WHEN p_partkey % 10 = 3 THEN 'moved' WHEN p_partkey % 10 = 4 THEN 'removed' END AS kind, 'function' AS type, p_partkey::VARCHAR AS old_id,
CASE WHEN p_partkey % 10 <> 4 THEN 'n' || p_partkey END AS new_id FROM part WHERE p_partkey % 10 IN (1, 2, 3, 4) UNION ALL SELECT 'added', 'function', NULL, 'n' || p_partkey FROM part WHERE p_partkey % 10 = 5""")
def code_diff_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("CAST(p_partkey AS STRING) AS id", "'function' AS type", "p_brand AS file", "concat('f', p_partkey) AS name", "concat('func f', p_partkey, '(a', p_partkey, ')') AS signature", "p_name AS doc", "p_partkey % 10 AS m")
    columns = ["id", "type", "file", "name", "signature", "doc"]
    new = rows.where("m <> 4").withColumns({
        "id": F.concat(F.lit("n"), "id"),
        "file": F.when(F.col("m") == 3, F.concat("file", F.lit("/moved"))).otherwise(F.col("file")),
        "doc": F.when(F.col("m") == 1, F.concat("doc", F.lit("!"))).otherwise(F.col("doc")),
        "signature": F.when(F.col("m") == 2, F.regexp_replace("signature", "func f", "func g")).otherwise(F.col("signature")),
        "name": F.when(F.col("m") == 2, F.regexp_replace("name", "^f", "g")).otherwise(F.col("name")),
    })
    return diff.diff_code(rows.where("m <> 5").select(columns), new.select(columns))


@query("""SELECT event_id::VARCHAR AS path, CASE event_id % 9 WHEN 1 THEN 'added' WHEN 2 THEN 'deleted' ELSE 'changed' END AS change FROM events WHERE event_id % 9 IN (1, 2, 3)""")
def drift_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "events").selectExpr("CAST(event_id AS STRING) AS path", "event_id AS mtime", "event_id % 9 AS m")
    return diff.file_drift(files.where("m <> 1").select("path", "mtime"), files.where("m <> 2").selectExpr("path", "IF(m = 3, mtime + 1, mtime) AS mtime"))


@query("""SELECT 'node' AS kind, id, v AS value, NULL::VARCHAR AS dst FROM (SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 4 = 1 THEN 'new' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 4 <> 0) UNION ALL SELECT 'node', 'extra', 'x', NULL
UNION ALL SELECT 'edge', o_orderkey::VARCHAR, 'NEXT', (o_orderkey + 1)::VARCHAR FROM orders WHERE o_orderkey % 4 <> 0 AND (o_orderkey + 1) NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0) UNION ALL SELECT 'edge', 'extra', 'NEXT', '1'""")
def delta_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    nodes = orders.selectExpr("CAST(o_orderkey AS STRING) AS id", "'order' AS type", "'' AS name", "map('v', o_orderstatus) AS attrs")
    none = F.create_map().cast("map<string,string>")
    edges = orders.selectExpr("CAST(o_orderkey AS STRING) AS src", "CAST(o_orderkey + 1 AS STRING) AS dst", "'NEXT' AS type", "o_orderkey AS ord").withColumn("attrs", none)
    removed = orders.where("o_orderkey % 4 = 0").selectExpr("CAST(o_orderkey AS STRING) AS id")
    more = orders.where("o_orderkey % 4 = 1").selectExpr("CAST(o_orderkey AS STRING) AS id", "'order' AS type", "'' AS name", "map('v', 'new') AS attrs").unionByName(spark.createDataFrame([("extra", "order", "", {"v": "x"})], nodes.schema))
    link = spark.createDataFrame([("extra", "1", "NEXT", 0)], "src string, dst string, type string, ord bigint").withColumn("attrs", none)
    after = Graph(nodes, edges).apply_delta(removed, more, link)
    shown = after.nodes.select(F.lit("node").alias("kind"), "id", F.col("attrs")["v"].alias("value"), F.lit(None).cast("string").alias("dst"))
    return shown.unionByName(after.edges.select(F.lit("edge").alias("kind"), F.col("src").alias("id"), F.col("type").alias("value"), "dst"))


@query("""WITH t AS (SELECT user_id, event_type, count(*) AS n, max(event_id) AS at FROM events GROUP BY 1, 2), m AS (SELECT user_id AS doc, event_type AS token FROM t), g AS (SELECT event_type AS token, max(event_id) AS at FROM events WHERE event_type <> 'error' AND event_id % 2 = 0 GROUP BY 1),
d AS (SELECT user_id AS doc, max(event_id) AS at FROM events GROUP BY 1), c AS (SELECT doc, count(*) FILTER (WHERE g.token IS NULL) AS broken, count(*) FILTER (WHERE g.at > d.at) AS stale FROM m JOIN d USING (doc) LEFT JOIN g USING (token) GROUP BY doc)
SELECT doc::VARCHAR AS doc, broken, stale FROM c WHERE broken + stale > 0 ORDER BY broken + stale DESC, doc::VARCHAR LIMIT 15""")
def doc_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    mentions = events.selectExpr("CAST(user_id AS STRING) AS doc", "event_type AS token")
    targets = events.where("event_type <> 'error' AND event_id % 2 = 0").selectExpr("event_type AS token", "concat('t:', event_type) AS target").distinct()
    changed = events.groupBy(F.col("user_id").cast("string").alias("id")).agg(F.max("event_id").alias("at")).unionByName(events.where("event_type <> 'error' AND event_id % 2 = 0").groupBy(F.concat(F.lit("t:"), "event_type").alias("id")).agg(F.max("event_id").alias("at")))
    return diff.doc_drift(mentions, targets, changed)
