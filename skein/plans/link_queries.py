"""Link resolution on equivalent shapes of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import link
from skein.plans.registry import query, table

#: Names are a part's name and size; where something is defined, the size counts from the other end, and half of the definitions are in a scope of no use.
USES = """u AS (SELECT p_partkey AS use_id, p_name || ' ' || p_brand || p_size AS name, p_brand AS scope, p_size % 2 = 0 AS local FROM part),
c AS (SELECT p_partkey AS id, p_name || ' ' || p_brand || (51 - p_size) AS name, CASE WHEN p_size > 25 THEN p_brand ELSE p_type END AS scope, p_retailprice AS ord FROM part)"""
RESOLVED = f"""{USES}, named AS (SELECT name, count(*) n, min(id) o FROM c GROUP BY name), near AS (SELECT name, scope, arg_min(id, (ord, id)) i FROM c GROUP BY 1, 2),
r AS (SELECT use_id, name, local, coalesce(i, CASE WHEN NOT local AND n = 1 THEN o END) AS target, n FROM u LEFT JOIN near USING (name, scope) LEFT JOIN named USING (name)),
s AS (SELECT use_id, name, local, target, CASE WHEN target IS NOT NULL THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status FROM r)"""


def uses_and_candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    uses = part.selectExpr("p_partkey AS use_id", "concat(p_name, ' ', p_brand, p_size) AS name", "p_brand AS scope", "p_size % 2 = 0 AS local")
    found = part.selectExpr("p_partkey AS id", "concat(p_name, ' ', p_brand, 51 - p_size) AS name", "IF(p_size > 25, p_brand, p_type) AS scope", "struct(p_retailprice, p_partkey) AS ord")
    return uses, found


@query(f"WITH {RESOLVED} SELECT use_id, target, status FROM s")
def unique_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.resolve_names(*uses_and_candidates(spark, sf_dir))


@query(f"WITH {RESOLVED} SELECT DISTINCT 'call:' || name AS id, name FROM s WHERE status = 'unresolved' AND NOT local AND name <> 'red widget Brand#1111'")
def stub_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses, candidates = uses_and_candidates(spark, sf_dir)
    return link.stubs(uses, link.resolve_names(uses, candidates), spark.createDataFrame([("red widget Brand#1111",)], "name string"))


RANGES = "r AS (SELECT o_orderkey AS range_id, o_custkey % 50 AS scope, o_orderkey % 1000 AS low, o_orderkey % 1000 + o_custkey % 40 AS high FROM orders), p AS (SELECT event_id AS point_id, user_id % 50 AS scope, event_id % 1000 AS \"at\" FROM events)"


def points_and_ranges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ranges = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS range_id", "o_custkey % 50 AS scope", "o_orderkey % 1000 AS low", "o_orderkey % 1000 + o_custkey % 40 AS high")
    return table(spark, sf_dir, "events").selectExpr("event_id AS point_id", "user_id % 50 AS scope", "event_id % 1000 AS at"), ranges


@query(f"""WITH {RANGES}, b AS (SELECT point_id, "at", arg_max(range_id, (low, range_id)) AS range_id, arg_max(high, (low, range_id)) AS high FROM p LEFT JOIN r ON p.scope = r.scope AND low <= "at" GROUP BY 1, 2)
SELECT point_id, CASE WHEN high >= "at" THEN range_id END AS range_id FROM b""")
def innermost_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.innermost(*points_and_ranges(spark, sf_dir))


@query(f"""WITH {RANGES} SELECT point_id, arg_max(range_id, (low, range_id)) AS range_id FROM p LEFT JOIN r ON p.scope = r.scope AND low <= "at" AND high >= "at" GROUP BY 1""")
def containment_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.innermost(*points_and_ranges(spark, sf_dir), contained_first=True)


CO = """i AS (SELECT DISTINCT l_orderkey b, l_suppkey s FROM lineitem), z AS (SELECT b FROM i GROUP BY b HAVING count(*) BETWEEN 2 AND 20), f AS (SELECT i.* FROM i JOIN z USING (b)),
pc AS (SELECT x.s a, y.s b, count(*) c FROM f x JOIN f y ON x.b = y.b AND x.s < y.s GROUP BY 1, 2 HAVING count(*) >= 3), n AS (SELECT s, count(*) n FROM f GROUP BY s),
co AS (SELECT pc.a, pc.b, c AS count, round(c / least(na.n, nb.n), 6) AS ratio, CASE WHEN c >= 5 AND c / least(na.n, nb.n) >= 0.05 THEN 'high' WHEN c / least(na.n, nb.n) >= 0.03 THEN 'medium' ELSE 'low' END AS band
FROM pc JOIN n na ON na.s = pc.a JOIN n nb ON nb.s = pc.b)"""


def supplier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    baskets = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS basket", "l_suppkey AS item")
    return link.co_change(baskets, high=0.05, medium=0.03).withColumn("ratio", F.round("ratio", 6))


@query(f"WITH {CO} SELECT * FROM co")
def cochange_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_pairs(spark, sf_dir)


@query(f"WITH {CO} SELECT co.* FROM co WHERE NOT EXISTS (SELECT 1 FROM supplier x JOIN supplier y USING (s_nationkey) WHERE x.s_suppkey = co.a AND y.s_suppkey = co.b)")
def cochange_not_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    pairs = supplier_pairs(spark, sf_dir)
    a, b = nation.select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("x")), nation.select(F.col("s_suppkey").alias("b"), F.col("s_nationkey").alias("y"))
    return pairs.join(a, "a").join(b, "b").where("x <> y").select("a", "b", "count", "ratio", "band")


FIELDS = [("order", "CustomerId"), ("order", "part_id"), ("order", "note"), ("part", "OrderID"), ("part", "SupplierId"), ("line_item", "OrderId"), ("line_item", "line_item_id"), ("nation", "RegionId"), ("customer", "nation_id"), ("customer", "DoubleId")]
MODELS = [("order", "Order"), ("customer", "Customer"), ("part", "Part"), ("supplier", "Supplier"), ("line_item", "LineItem"), ("nation", "Nation"), ("region", "Region"), ("d1", "Double"), ("d2", "Double")]
values = lambda rows: ", ".join(str(r) for r in rows)


@query(f"""WITH f(model, field) AS (VALUES {values(FIELDS)}), m(id, name) AS (VALUES {values(MODELS)}), b AS (SELECT model, field, regexp_replace(field, '(Id|_id|ID)$', '') AS base FROM f WHERE regexp_matches(field, '.(Id|_id|ID)$')),
p AS (SELECT model, field, array_to_string([upper(x[1]) || x[2:] for x in string_split(base, '_')], '') AS name FROM b), u AS (SELECT name, min(id) AS dst FROM m GROUP BY name HAVING count(*) = 1)
SELECT model AS src, dst, min(field) AS field FROM p JOIN u USING (name) WHERE model <> dst AND NOT (least(model, dst) = 'nation' AND greatest(model, dst) = 'region') GROUP BY 1, 2""")
def fk_name_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.infer_references(spark.createDataFrame(FIELDS, "model string, field string"), spark.createDataFrame(MODELS, "id string, name string"), spark.createDataFrame([("region", "nation")], "src string, dst string"))


@query("""WITH m AS (SELECT 'm' || r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 'x', r_name FROM region WHERE r_regionkey = 2),
u AS (SELECT name, min(id) AS id FROM m GROUP BY name HAVING count(*) = 1),
a AS (SELECT x.r_name AS f, y.r_name AS t, (n_nationkey % 2)::VARCHAR AS kind, '' AS "as", n_nationkey AS ord FROM nation JOIN region x ON x.r_regionkey = n_regionkey JOIN region y ON y.r_regionkey = n_nationkey % 4)
SELECT uf.id AS src, ut.id AS dst, kind, "as", min(ord) AS ord FROM a JOIN u uf ON uf.name = f JOIN u ut ON ut.name = t GROUP BY ALL""")
def assoc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    models = region.selectExpr("concat('m', r_regionkey) AS id", "r_name AS name").unionByName(region.where("r_regionkey = 2").selectExpr("'x' AS id", "r_name AS name"))
    x, y = region.selectExpr("r_regionkey AS x", "r_name AS from_name"), region.selectExpr("r_regionkey AS y", "r_name AS to_name")
    assocs = table(spark, sf_dir, "nation").join(x, F.expr("x = n_regionkey")).join(y, F.expr("y = n_nationkey % 4")).selectExpr("from_name", "to_name", "CAST(n_nationkey % 2 AS STRING) AS kind", "'' AS `as`", "n_nationkey AS ord")
    return link.associate(assocs, models)


ROUTES = [("r1", "a", "GET", "/en/:id"), ("r2", "a", "GET", "/de/:id"), ("r3", "b", "", "/:lang/:id/"), ("r4", "a", "POST", "/fr/:id"), ("r5", "b", "GET", "/x/es/:id"), ("r6", "c", "GET", "/en/1"), ("r7", "c", "GET", "/fr/:id")]


@query(f"""WITH r(route_id, file, method, path) AS (VALUES {values(ROUTES)}), rr AS (SELECT route_id, file AS rf, method AS rm, list_reverse(list_filter(string_split(path, '/'), lambda x: x <> '')) AS rt FROM r),
c AS (SELECT page_id AS call_id, CASE WHEN page_id % 3 = 0 THEN 'GET' ELSE '' END AS method, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
cc AS (SELECT *, list_reverse(list_filter(string_split(path, '/'), lambda x: x <> '')) AS t FROM c),
m AS (SELECT call_id, route_id, least(len(t), len(rt)) AS score FROM cc, rr WHERE rf <> 'c' AND (method = rm OR method = '' OR rm = '') AND len(t) > 0
  AND len(list_filter(range(1, least(len(t), len(rt)) + 1), lambda i: t[i] <> rt[i] AND NOT starts_with(t[i], ':') AND NOT starts_with(rt[i], ':'))) = 0),
b AS (SELECT call_id, max(score) AS score FROM m GROUP BY 1)
SELECT call_id, min(route_id) AS route_id, score::INT AS score FROM m JOIN b USING (call_id, score) GROUP BY 1, 3 HAVING count(*) = 1""")
def route_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "pages").select(F.col("page_id").alias("call_id"), F.lit("c").alias("file"), F.when(F.col("page_id") % 3 == 0, "GET").otherwise("").alias("method"), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("path"), F.lit(False).alias("relative"))
    return link.route_matches(calls, spark.createDataFrame(ROUTES, "route_id string, file string, method string, path string"))


@query("""WITH f AS (SELECT page_id AS id, regexp_extract(url, '://[^/?#]*/([^?#]*)', 1) AS path FROM pages),
t AS (SELECT DISTINCT id AS doc, CASE id % 3 WHEN 0 THEN path WHEN 1 THEN regexp_extract(path, '([^/]*/?)$', 1) ELSE 'part ' || (9000 + id % 1200) END AS token FROM f),
s AS (SELECT id, array_to_string(p[i:], '/') AS token FROM (SELECT id, string_split(path, '/') AS p FROM f), range(2, 20) r(i) WHERE i <= len(p)),
n AS (SELECT p_partkey AS id, 'part ' || (p_retailprice * 10)::INT AS token, p_partkey % 2 AS rank FROM part),
h AS (SELECT doc, token, id, 0 AS tier FROM t JOIN (SELECT id, path AS token FROM f) USING (token) UNION ALL SELECT doc, token, id, 1 FROM t JOIN s USING (token) WHERE regexp_matches(token, '[/.]')
  UNION ALL SELECT doc, token, id, rank + 2 FROM t JOIN n USING (token) WHERE NOT regexp_matches(token, '[/.]')),
b AS (SELECT doc, token, min(tier) AS tier FROM h GROUP BY 1, 2), d AS (SELECT DISTINCT h.* FROM h JOIN b USING (doc, token, tier))
SELECT doc, token, id AS target, tier::INT AS tier FROM d WHERE (doc, token) IN (SELECT (doc, token) FROM d GROUP BY doc, token HAVING count(*) <= 3)""")
def mention_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("url", "://[^/?#]*/([^?#]*)", 1).alias("path"))
    token = F.when(F.col("id") % 3 == 0, F.col("path")).when(F.col("id") % 3 == 1, F.regexp_extract("path", "([^/]*/?)$", 1)).otherwise(F.concat(F.lit("part "), F.lit(9000) + F.col("id") % 1200))
    names = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "concat('part ', CAST(round(p_retailprice * 10) AS INT)) AS name", "CAST(p_partkey % 2 AS INT) AS rank")
    return link.mention_targets(files.select(F.col("id").alias("doc"), token.alias("token")), files, names)


@query("""WITH k AS (SELECT event_id, user_id, event_type, regexp_extract(props, '"k": (\\d+)', 1) AS key FROM events), f AS (SELECT key, arg_min(user_id, event_id) AS target FROM k WHERE event_type = 'signup' GROUP BY key)
SELECT user_id AS caller_id, target, event_id AS ord FROM k JOIN f USING (key) WHERE event_type = 'click' AND user_id <> target""")
def dispatch_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("key", F.get_json_object("props", "$.k"))
    registered = events.where("event_type = 'signup'").select("key", F.col("user_id").alias("target"), F.col("event_id").alias("ord"))
    return link.dispatch_links(registered, events.where("event_type = 'click'").select(F.col("user_id").alias("caller_id"), "key", F.col("event_id").alias("ord")))


@query("""WITH RECURSIVE own AS (SELECT p_partkey AS file, p_name AS name FROM part),
k(file, name, target_file, target_name, depth) AS (SELECT file, name, file, name, 0 FROM own
  UNION ALL SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN k.name ELSE 'as ' || k.name END, target_file, target_name, depth + 1 FROM k JOIN part ON p_partkey // 3 = k.file AND p_partkey <> k.file
    WHERE depth < 5 AND (p_size % 2 = 0 OR k.name = (SELECT name FROM own WHERE own.file = k.file))),
b AS (SELECT file, name, target_file, target_name, row_number() OVER (PARTITION BY file, name ORDER BY depth, target_file, target_name) AS n FROM k)
SELECT file, name, target_file, target_name FROM b WHERE n = 1""")
def reexport_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part is a file that defines its name; it passes on all names of the part of a third of its key, or that part's own name as another."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file"), (F.col("p_partkey") / 3).cast("long").cast("string").alias("source_file"), "p_name", F.col("p_size") % 2 == 0)
    part = part.toDF("file", "source_file", "name", "star")
    nothing = F.lit(None).cast("string")
    own = part.select("file", "name", nothing.alias("source_file"), nothing.alias("source_name"), F.lit(False).alias("star"))
    source = part.select(F.col("file").alias("source_file"), F.col("name").alias("source_name"))
    passed = part.where("file <> source_file").drop("name").join(source, "source_file").select("file", F.when(F.col("star"), nothing).otherwise(F.concat(F.lit("as "), "source_name")).alias("name"), "source_file", "source_name", "star")
    found = link.resolve_exports(own.unionByName(passed))
    return found.select(F.col("file").cast("long").alias("file"), "name", F.col("target_file").cast("long").alias("target_file"), "target_name")


@query("""WITH a AS (SELECT DISTINCT user_id AS id, regexp_extract(props, '"k": (\\d+)', 1) AS state, CASE WHEN event_type IN ('view', 'click') THEN 'READS' ELSE 'WRITES' END AS kind FROM events WHERE event_type <> 'error'),
n AS (SELECT state, kind, list_sort(list(id::VARCHAR)) AS ids FROM a GROUP BY 1, 2), p AS (SELECT DISTINCT id, state FROM a)
SELECT id, state, kind, (len(ids) - list_contains(ids, id::VARCHAR)::INT)::BIGINT AS n_others, array_to_string(list_filter(ids, lambda x: x <> id::VARCHAR)[1:6], ',') AS others
FROM p JOIN n USING (state) WHERE len(ids) > list_contains(ids, id::VARCHAR)::INT""")
def shared_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("event_type <> 'error'")
    accesses = events.select(F.col("user_id").cast("string").alias("id"), F.get_json_object("props", "$.k").alias("state"), F.when(F.col("event_type").isin("view", "click"), "READS").otherwise("WRITES").alias("kind"))
    found = link.shared_state(accesses)
    return found.select(F.col("id").cast("long").alias("id"), "state", "kind", "n_others", F.array_join("others", ",").alias("others"))


@query("""WITH d AS (SELECT source AS basename, sha256(text) AS hash, doc_id FROM documents), a AS (SELECT basename, count(*) AS all_n FROM d GROUP BY 1)
SELECT basename, hash, count(*) AS n, min(doc_id) AS first_id, count(*) - 1 AS identical, any_value(all_n) - count(*) AS diverged FROM d JOIN a USING (basename) WHERE all_n > 1 GROUP BY 1, 2""")
def copies_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.sibling_copies(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("basename"), F.sha2("text", 256).alias("hash")))


@query("""WITH u AS (SELECT DISTINCT page_id AS file, regexp_extract(url, '/([0-9]+)[^/]*$', 1) AS token FROM pages), d AS (SELECT s_suppkey AS css, s_suppkey::VARCHAR AS token FROM supplier
  UNION SELECT s_suppkey, (s_suppkey + s_nationkey)::VARCHAR FROM supplier UNION SELECT s_suppkey, s_nationkey::VARCHAR FROM supplier), k AS (SELECT token FROM d GROUP BY token HAVING count(*) <= 3)
SELECT file, css, substr(string_agg(DISTINCT token, ',' ORDER BY token), 1, 200) AS selectors FROM u JOIN d USING (token) WHERE file <> css AND token IN (SELECT token FROM k) GROUP BY 1, 2""")
def style_wiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), F.regexp_extract("url", "/([0-9]+)[^/]*$", 1).alias("token"))
    names = F.array("s_suppkey", F.col("s_suppkey") + F.col("s_nationkey"), F.col("s_nationkey").cast("long")).cast("array<string>")
    return link.style_links(used, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), F.explode(names).alias("token")))
