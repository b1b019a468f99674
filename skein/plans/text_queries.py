"""Grep, trees and the text functions, over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as fn
from skein.operators import scan
from skein.plans.registry import query, table

LINES = "l AS (SELECT lpad(doc_id::VARCHAR, 9, '0') AS path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.col("text").alias("content"))


@query(f"WITH {LINES}, h AS (SELECT * FROM l WHERE contains(lower(text), 'license')) SELECT path, line::INT AS line, text, (SELECT count(*) FROM h) AS total FROM h ORDER BY path, line LIMIT 50")
def grep_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, total = scan.grep(doc_files(spark, sf_dir), "License")
    return hits.join(F.broadcast(total))


@query(f"WITH {LINES}, h AS (SELECT * FROM l WHERE regexp_matches(text, '(?i)licen[sc]ed? .*(version [0-9]|cc by)')) SELECT path, line::INT AS line, text, (SELECT count(*) FROM h) AS total FROM h ORDER BY path, line LIMIT 50")
def grep_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, total = scan.grep(doc_files(spark, sf_dir), "licen[sc]ed? .*(version [0-9]|cc by)", regex=True)
    return hits.join(F.broadcast(total))


PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query(f"""WITH p AS (SELECT {PATH} AS path FROM pages), s AS (SELECT path, string_split(path, '/') AS x FROM p)
SELECT DISTINCT CASE WHEN len(x) > 2 THEN array_to_string(x[1:2], '/') || '/...' ELSE path END AS entry FROM s""")
def tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return scan.tree(table(spark, sf_dir, "pages").select(path.alias("path")), depth=2)


@query("""WITH q AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '"' || url || '"' WHEN 1 THEN 'fetch(`${base}/users/${id}/x`' || chr(96) WHEN 2 THEN '''/a/%s/{b}/$c/' || page_id || '''' ELSE url END AS raw FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '^[a-z]+://[^/]*', '') WHEN 1 THEN '/users/:param/x' WHEN 2 THEN '/a/:param/:param/:param/' || page_id ELSE '' END AS path FROM q JOIN pages USING (page_id)""")
def client_path_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("page_id") % 4
    raw = F.when(kind == 0, F.concat(F.lit('"'), "url", F.lit('"'))).when(kind == 1, "fetch(`${base}/users/${id}/x``").when(kind == 2, F.concat(F.lit("'/a/%s/{b}/$c/"), "page_id", F.lit("'"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", fn.client_path(raw).alias("path"))



@query("""SELECT page_id, array_to_string(list_sort(['#top', '--gap' || page_id, '.ad' || page_id, '.b-' || length(url), '.in', '[data-k]']), ',') AS selectors FROM pages""")
def css_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    css = F.concat(F.lit(".ad"), "page_id", F.lit(",#top>a.b-"), F.length("url"), F.lit("{--gap"), "page_id", F.lit(": 2px; color:red}/* .no{} */ @media x{.in[data-k]{a:b}}"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(fn.css_selectors(css), ",").alias("selectors"))


@query("""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS t, generate_subscripts(string_split(html, chr(10)), 1) AS line FROM pages),
m AS (SELECT page_id, line, unnest(regexp_extract_all(t, '(?i)\\b(href|src|action)\\s*=\\s*["'']([^"'']*)["'']', 1)) AS name, unnest(regexp_extract_all(t, '(?i)\\b(href|src|action)\\s*=\\s*["'']([^"'']*)["'']', 2)) AS value FROM l)
SELECT page_id, lower(name) AS name, value, line::INT AS line FROM m""")
def template_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(fn.attribute_links(F.col("html"), ("href", "src", "action"))).alias("x"))
    return found.select("page_id", "x.name", "x.value", "x.line")


@query("""SELECT page_id, len(b) AS n, sha256(array_to_string(b, chr(10))) AS body_hash FROM (SELECT page_id, regexp_extract_all(html, '(?is)<script\\b[^>]*>(.*?)</script>', 1) AS b FROM pages)""")
def mask_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = fn.script_bodies(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(bodies).cast("long").alias("n"), F.sha2(F.array_join(bodies, "\n"), 256).alias("body_hash"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '"([^"\\n]{1,80})"', 1)) AS x FROM documents), b AS (SELECT doc_id, regexp_replace(x, '\\(\\)$', '') AS token FROM t)
SELECT doc_id, token, count(*) AS n FROM b WHERE regexp_full_match(token, '[A-Za-z_][\\w./-]*') AND token NOT LIKE '%/' AND NOT (contains(token, '_') AND token = upper(token)) GROUP BY 1, 2""")
def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(fn.doc_tokens(F.col("text"), '"')).alias("token"))
    return found.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS mentioned, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS wired, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS gap FROM documents WHERE contains(text, 'stupid')""")
def coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return scan.coverage_gap(texts, "stupid", table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query("""SELECT p_partkey, column_name AS "column", values FROM part, (VALUES ('kind'), ('size')) v(column_name),
LATERAL (SELECT CASE column_name WHEN 'kind' THEN p_type || ', ' || p_brand ELSE p_size || ', ' || (p_size + 1) END AS values)""")
def check_enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value lists of the CHECK constraints of a table made for each part."""
    ddl = F.concat(F.lit('CREATE TABLE t (a INT CHECK (a > 0), "Kind" TEXT CHECK ("Kind" IN (\''), "p_type", F.lit("', '"), "p_brand", F.lit("')), size INT check(size in ("), F.col("p_size").cast("string"), F.lit(","), (F.col("p_size") + 1).cast("string"), F.lit(")))"))
    found = table(spark, sf_dir, "part").select("p_partkey", F.explode(fn.check_enums(ddl)).alias("x"))
    return found.select("p_partkey", "x.column", "x.values")


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN NULL ELSE '#hero-' || page_id || ',--gap' || page_id || ',.btn,.card-' || length(url) || ',[data-k]' END AS tokens FROM pages""")
def style_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of markup; even pages have none."""
    mark = F.concat(F.lit('<div class="btn card-'), F.length("url"), F.lit('" data-k="1"><p id=\'hero-'), "page_id", F.lit("'></p><i style=\"w: var(--gap"), "page_id", F.lit(')"></i>'))
    tokens = F.array_join(fn.style_uses(F.when(F.col("page_id") % 2 == 0, "<p>plain text, no class</p>").otherwise(mark)), ",")
    return table(spark, sf_dir, "pages").select("page_id", F.nullif(tokens, F.lit("")).alias("tokens"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'call(' || page_id || ')' WHEN 1 THEN 'a' || page_id || ';b' ELSE '' END AS body FROM pages""")
def mask_script_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline scripts only: none with a source, none of another type."""
    kind = F.col("page_id") % 4
    text = F.concat(F.when(kind == 0, "call(").when(kind == 1, "a").otherwise("x"), "page_id", F.when(kind == 0, ")").when(kind == 1, ";b").otherwise(""))
    head = F.when(kind == 0, "<script>").when(kind == 1, '<SCRIPT type="module" defer>').when(kind == 2, "<script src='/a.js'>").otherwise('<script type="application/json">')
    bodies = fn.script_bodies(F.concat(F.lit("<p>\n"), head, text, F.lit("</script ><b>x</b>")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(bodies, "\n").alias("body"))


@query("""SELECT p_partkey, ends_with(path, '.pb.go') OR contains(head, 'DO NOT EDIT') AS generated, starts_with(path, '/') AND NOT contains(path, ' ') AS client
FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '/a/' || p_partkey || '.pb.go' WHEN 1 THEN '/b ' || p_partkey ELSE 'c' || p_partkey END AS path, CASE WHEN p_size % 5 = 0 THEN '// Code generated; DO NOT EDIT.' ELSE p_name END AS head FROM part)""")
def path_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_size") % 3
    path = F.when(kind == 0, F.concat(F.lit("/a/"), "p_partkey", F.lit(".pb.go"))).when(kind == 1, F.concat(F.lit("/b "), "p_partkey")).otherwise(F.concat(F.lit("c"), "p_partkey"))
    head = F.when(F.col("p_size") % 5 == 0, "// Code generated; DO NOT EDIT.").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", fn.is_generated(path, head).alias("generated"), fn.is_client_path(path).alias("client"))
