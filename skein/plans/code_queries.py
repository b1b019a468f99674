"""Companions, callers, state, comments, snippets, specifications, projects and vectors on equivalent shapes of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import code, scan, vectors
from skein.plans.registry import query, table
from skein.sources import projects


@query("SELECT 'p' || p_partkey AS id FROM part WHERE p_size = 1 UNION SELECT DISTINCT 'p' || l_partkey FROM lineitem WHERE l_quantity > 48")
def generated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").selectExpr("concat('p', p_partkey) AS id", "IF(p_size = 1, map('generated', 'true'), map('generated', 'no')) AS attrs")
    edges = table(spark, sf_dir, "lineitem").selectExpr("concat('s', l_suppkey) AS src", "concat('p', l_partkey) AS dst", "IF(l_quantity > 48, 'GENERATES', 'CALLS') AS type")
    return code.generated(nodes, edges)


@query("""WITH p AS (SELECT 'u' || user_id AS a, 'k' || regexp_extract(props, '"k": (\\d+)', 1) AS b, count(*) AS count FROM events GROUP BY 1, 2), e AS (SELECT a AS id, b AS other, count FROM p UNION ALL SELECT b, a, count FROM p)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY count DESC, other)::INT AS place FROM e) WHERE place <= 10""")
def companions_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("a"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("b"))
    return code.companions(events.groupBy("a", "b").agg(F.count("*").alias("count")))


@query("""SELECT 'p' || l_partkey AS id, count(DISTINCT l_suppkey) AS n, array_to_string(list_sort(list(DISTINCT 's' || l_suppkey))[1:8], ',') AS callers FROM lineitem GROUP BY l_partkey""")
def callers_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").selectExpr("concat('s', l_suppkey) AS src", "concat('p', l_partkey) AS dst", "'CALLS' AS type")
    return code.current_callers(edges).withColumn("callers", F.array_join("callers", ","))


@query("""WITH f AS (SELECT p_brand AS file, p_name || p_size AS name, count(*) AS n, min('func:' || p_brand || ':' || p_name || p_size || ':' || p_partkey) AS target FROM part GROUP BY 1, 2)
SELECT DISTINCT 'func:' || p_brand || ':' || p_name || (51 - p_size) || ':0' AS id, target FROM part JOIN f ON f.file = p_brand AND f.name = p_name || (51 - p_size) AND n = 1""")
def relinked_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's id under the size from the other end, as one whose line is stale; ids of five parts mean nothing."""
    part = table(spark, sf_dir, "part")
    live = part.selectExpr("concat_ws(':', 'func', p_brand, concat(p_name, p_size), p_partkey) AS id", "p_brand AS file", "concat(p_name, p_size) AS name")
    stale = part.selectExpr("concat_ws(':', 'func', p_brand, concat(p_name, 51 - p_size), '0') AS id")
    return code.relinked(stale.unionByName(stale.selectExpr("concat(id, ':x') AS id")), live)


@query("""WITH h AS (SELECT r_name AS route, 'n' || n_nationkey AS id FROM region JOIN nation ON n_regionkey = r_regionkey), c AS (SELECT DISTINCT 'n' || s_nationkey AS a, 's' || s_suppkey AS b FROM supplier UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem WHERE l_quantity > 49),
l1 AS (SELECT DISTINCT route, b AS id FROM h JOIN c ON a = id), l2 AS (SELECT DISTINCT route, b AS id FROM l1 JOIN c ON a = id), s AS (FROM h UNION FROM l1 UNION FROM l2),
f AS (SELECT 'n' || n_nationkey AS id, n_name AS file FROM nation UNION ALL SELECT 's' || s_suppkey, 'sup' || s_nationkey FROM supplier UNION ALL SELECT 'p' || p_partkey, p_brand FROM part),
o AS (SELECT DISTINCT route, file FROM s JOIN f USING (id)), i AS (SELECT DISTINCT p_brand AS file, p_type AS to_file FROM part WHERE p_size = 7), a AS (FROM o UNION SELECT route, to_file FROM o JOIN i USING (file)),
m AS (SELECT p_name AS model, CASE WHEN p_size > 40 THEN p_type WHEN p_size > 35 THEN p_brand ELSE 'none' END AS file FROM part) SELECT DISTINCT route, model FROM a JOIN m USING (file)""")
def route_models_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, supplier, part = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier", "part"))
    handled = region.join(nation, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("r_name AS route", "concat('n', n_nationkey) AS id")
    calls = supplier.selectExpr("concat('n', s_nationkey) AS a", "concat('s', s_suppkey) AS b").unionByName(table(spark, sf_dir, "lineitem").where("l_quantity > 49").selectExpr("concat('s', l_suppkey) AS a", "concat('p', l_partkey) AS b").distinct())
    files = nation.selectExpr("concat('n', n_nationkey) AS id", "n_name AS file").unionByName(supplier.selectExpr("concat('s', s_suppkey) AS id", "concat('sup', s_nationkey) AS file")).unionByName(part.selectExpr("concat('p', p_partkey) AS id", "p_brand AS file"))
    imports = part.where("p_size = 7").selectExpr("p_brand AS file", "p_type AS to_file").distinct()
    models = part.selectExpr("p_name AS model", "CASE WHEN p_size > 40 THEN p_type WHEN p_size > 35 THEN p_brand ELSE 'none' END AS file").distinct()
    return code.route_models(handled, calls, files, imports, models)


@query("""WITH a AS (SELECT event_id, event_type AS file, regexp_extract(props, '"k": (\\d+)', 1) AS name, event_id % 1000 AS line, CASE WHEN value > 20 THEN 'WRITES' ELSE 'READS' END AS kind FROM events),
b AS (SELECT DISTINCT file, name, 'state' || name AS state FROM a WHERE length(name) = 1), r AS (SELECT o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'error' END AS file, o_orderkey % 1000 AS low, o_orderkey % 1000 + o_custkey % 5 AS high FROM orders),
w AS (SELECT a.event_id, state, kind, arg_max(id, (low, id)) AS id FROM a JOIN b USING (file, name) JOIN r ON r.file = a.file AND low <= line AND high >= line GROUP BY ALL) SELECT DISTINCT id, state, kind FROM w""")
def state_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("access_id"), F.col("event_type").alias("file"), F.get_json_object("props", "$.k").alias("name"), (F.col("event_id") % 1000).alias("line"), F.when(F.col("value") > 20, "WRITES").otherwise("READS").alias("kind"))
    bound = events.where(F.length("name") == 1).select("file", "name", F.concat(F.lit("state"), "name").alias("state")).distinct()
    ranges = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CASE o_custkey % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'error' END AS file", "o_orderkey % 1000 AS low", "o_orderkey % 1000 + o_custkey % 5 AS high")
    return code.state_access(events, bound, ranges)


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS file, l_linenumber * (1 + l_orderkey % 3) AS line, l_returnflag AS text FROM lineitem), u AS (SELECT file, line, min(text) AS text FROM c GROUP BY 1, 2 HAVING line <> 2),
g AS (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY file ORDER BY line) > 1 THEN 1 WHEN lag(line) OVER (PARTITION BY file ORDER BY line) IS NULL THEN 1 ELSE 0 END AS b FROM u), p AS (SELECT *, sum(b) OVER (PARTITION BY file ORDER BY line) AS part FROM g)
SELECT file, min(line) AS line, max(line) AS "end", string_agg(text, ' ' ORDER BY line) AS text FROM p GROUP BY file, part""")
def comment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as comments; those on line 2 belong to a declaration."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") * (1 + F.col("l_orderkey") % 3)).cast("long").alias("line"), F.col("l_returnflag").alias("text"))
    comments = lines.groupBy("file", "line").agg(F.min("text").alias("text")).withColumn("end", F.col("line"))
    return code.merged_comments(comments, comments.where("line = 2").select("file", "line"))


@query("""WITH e AS (SELECT page_id AS endpoint, 'get' AS method, '/' || (page_id % 400) AS path FROM pages), r AS (SELECT p_partkey AS handler, CASE WHEN p_size > 10 THEN 'GET' ELSE 'POST' END AS method, '/' || (p_partkey // 3) AS path FROM part)
SELECT DISTINCT endpoint, handler FROM e JOIN r ON upper(e.method) = r.method AND e.path = r.path""")
def spec_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    endpoints = table(spark, sf_dir, "pages").selectExpr("page_id AS endpoint", "'get' AS method", "concat('/', page_id % 400) AS path")
    return code.spec_handlers(endpoints, table(spark, sf_dir, "part").selectExpr("p_partkey AS handler", "IF(p_size > 10, 'GET', 'POST') AS method", "concat('/', p_partkey div 3) AS path"))


@query("""WITH s AS (SELECT DISTINCT 'api.' || lower(replace(p_brand, '#', '')) || '.' || replace(p_name, ' ', '') AS name FROM part), t AS (SELECT DISTINCT 'src/' || lower(replace(p_brand, '#', '')) AS package, replace(p_name, ' ', '') AS name FROM part WHERE p_size > 20),
q AS (SELECT package || ':' || name AS type, replace(package, 'src/', '') AS pkg, package, name FROM t), n AS (SELECT name, count(*) AS n FROM q GROUP BY 1)
SELECT DISTINCT s.name AS schema, type FROM s JOIN q ON q.name = split_part(s.name, '.', 3) JOIN n ON n.name = q.name WHERE n = 1 OR ends_with('.' || s.name, '.' || pkg || '.' || q.name)""")
def spec_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").selectExpr("lower(replace(p_brand, '#', '')) AS brand", "replace(p_name, ' ', '') AS name", "p_size")
    schemas = part.selectExpr("concat('api.', brand, '.', name) AS name").distinct().withColumn("schema", F.col("name"))
    return code.spec_types(schemas, part.where("p_size > 20").selectExpr("brand AS package", "name").distinct().withColumn("type", F.concat(F.lit("src/"), "package", F.lit(":"), "name")))


@query("""WITH x AS (SELECT p_partkey AS file, p_name AS name, min(p_type) AS target FROM part GROUP BY 1, 2)
SELECT DISTINCT l_orderkey AS caller, target FROM lineitem JOIN x ON x.file = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey % 2 = 0""")
def namespace_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order calls a part's name through a supplier that half of the nations have imported."""
    part = table(spark, sf_dir, "part")
    lines = table(spark, sf_dir, "lineitem").join(part.selectExpr("p_partkey AS l_partkey", "p_name AS member"), "l_partkey")
    calls = lines.selectExpr("l_orderkey AS caller", "l_suppkey AS file", "l_partkey AS namespace", "member")
    bought = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").where("s_nationkey % 2 = 0").selectExpr("s_suppkey AS l_suppkey"), "l_suppkey")
    imports = bought.selectExpr("l_suppkey AS file", "l_partkey AS namespace", "l_partkey AS to_file").distinct()
    return code.namespace_calls(calls, imports, part.selectExpr("p_partkey AS file", "p_name AS name", "p_type AS target"))


@query("""WITH l AS (SELECT doc_id AS path, string_split(text, chr(10)) AS t FROM documents), f AS (SELECT path, CASE WHEN path % 4 = 0 THEN 'body ' || path END AS body, 1 AS low, len(t) AS high, t FROM l),
w AS (SELECT path, body, high, array_to_string(t[1:least(high, 15)], chr(10)) AS whole FROM f) SELECT path AS id, CASE WHEN body IS NOT NULL THEN body ELSE substr(whole, 1, 800) || CASE WHEN high > 15 OR length(whole) > 800 THEN chr(10) || '…' ELSE '' END END AS text FROM w""")
def snippet_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    functions = files.select(F.col("path").alias("id"), "path", F.when(F.col("path") % 4 == 0, F.concat(F.lit("body "), "path")).alias("body"), F.lit(1).alias("low"), F.size(F.split("content", "\n")).alias("high"))
    return code.snippets(functions, scan.lines_of(files))


@query("""WITH n AS (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'get' WHEN 1 THEN 'delete' WHEN 2 THEN 'getter' ELSE 'patch' END AS head, replace(p_type, ' ', '') AS rest, p_size FROM part)
SELECT id, CASE WHEN p_size % 4 = 2 THEN '' WHEN NOT regexp_matches(rest, '^[A-Z]') THEN '' ELSE upper(head) END AS verb FROM n""")
def verb_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("p_size") % 4 == 0, "get").when(F.col("p_size") % 4 == 1, "delete").when(F.col("p_size") % 4 == 2, "getter").otherwise("patch")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), code.verb_prefix(F.concat(head, F.regexp_replace("p_type", " ", ""))).alias("verb"))


URL_PATH = "regexp_extract(url, '://([^?#]*)', 1)"


@query(f"""WITH f AS (SELECT DISTINCT {URL_PATH} AS path FROM pages), m AS (SELECT DISTINCT regexp_extract({URL_PATH}, '^([^/]*)', 1) AS folder FROM pages WHERE contains(url, '.org') UNION SELECT regexp_extract({URL_PATH}, '^([^/]*/en)', 1) FROM pages WHERE contains(url, '/en/') AND contains(url, '.com')),
p AS (FROM m UNION SELECT '') SELECT f.path, arg_max(folder, length(folder)) AS folder FROM f JOIN p ON folder = '' OR starts_with(f.path, folder || '/') GROUP BY 1""")
def nearest_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files, with manifests in the folders of .org hosts and in /en of .com hosts."""
    pages = table(spark, sf_dir, "pages").select("url", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    manifests = pages.where("contains(url, '.org')").selectExpr("concat(regexp_extract(path, '^([^/]*)', 1), '/go.mod') AS path").unionByName(pages.where("contains(url, '.org')").selectExpr("concat(regexp_extract(path, '^([^/]*)', 1), '/package.json') AS path"))
    manifests = manifests.unionByName(pages.where("contains(url, '/en/') AND contains(url, '.com')").selectExpr("concat(regexp_extract(path, '^([^/]*/en)', 1), '/App.csproj') AS path"))
    return projects.nearest_project(pages.select("path").distinct(), projects.detect_projects(manifests.distinct()))


@query("""WITH o AS (SELECT vec_id::VARCHAR AS id, 'old' AS hash FROM embeddings WHERE label <> 3), n AS (SELECT vec_id::VARCHAR AS id, 'new' AS hash, embedding::DOUBLE[] AS v FROM embeddings WHERE label IN (3, 5)), s AS (SELECT id, hash, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size, v[1] AS x FROM n)
SELECT id, hash, 0::DOUBLE AS first FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, hash, round(x / size, 6) FROM s""")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("type"), F.col("embedding").cast("array<double>").alias("vector"))
    stored = rows.where("type <> '3'").select("id", "type", F.lit("old").alias("hash"), F.lit("m").alias("model"), F.array(F.lit(0.0)).alias("vector"))
    stored = stored.unionByName(stored.withColumns({"id": F.concat(F.lit("x"), "id"), "model": F.lit("another")}))
    kept = vectors.upsert(stored, rows.where("type IN ('3', '5')").withColumn("hash", F.lit("new")), "m")
    return kept.select("id", "hash", F.round(F.element_at("vector", 1), 6).alias("first"))
