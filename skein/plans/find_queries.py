"""Name, keyword, full-text, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators import find
from skein.plans.graph_queries import NAMES
from skein.plans.registry import query, table
from skein.sources import catalog

VECTORS = """q0 AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), q1 AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 1),
v AS (SELECT lpad(vec_id::VARCHAR, 9, '0') AS id, label, round(list_cosine_similarity(embedding::DOUBLE[], q0.q), 6) AS s0, round(list_cosine_similarity(embedding::DOUBLE[], q1.q), 6) AS s1 FROM embeddings, q0, q1)"""
QUERY = "the stupid license"
KEYWORD = f"""k AS (SELECT lpad(doc_id::VARCHAR, 9, '0') AS id, source AS name, ({" + ".join(f"contains(lower(source || ' ' || text), '{t}')::INT" for t in QUERY.split())})::DOUBLE AS score FROM documents)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("id"), F.col("label").cast("string").alias("type"), F.col("embedding").alias("vector"))


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding


def doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("id"), F.lit("document").alias("type"), F.col("source").alias("name"), "text")


@query(f"""SELECT id, score FROM (SELECT 'table:' || table_name AS id, table_name AS name, CASE WHEN table_name = 'nation' THEN 1.0 WHEN table_name LIKE 'nation%' THEN 0.9 WHEN contains(table_name, 'nation') THEN 0.8 END::DOUBLE AS score
FROM (SELECT DISTINCT table_name FROM information_schema.columns WHERE table_name IN ({NAMES})) UNION ALL
SELECT 'column:' || n, n, CASE WHEN n = 'nation' THEN 1.0 WHEN n LIKE 'nation%' THEN 0.9 WHEN contains(n, 'nation') THEN 0.8 END::DOUBLE FROM (SELECT table_name || '.' || column_name AS n FROM information_schema.columns WHERE table_name IN ({NAMES})))
WHERE score IS NOT NULL ORDER BY score DESC, name, id LIMIT 5""")
def name_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.name_find(catalog.extract(spark, sf_dir).nodes, "Nation", limit=5).select("id", "score")


@query(f"WITH {KEYWORD} SELECT id, score FROM k WHERE score > 0 ORDER BY score DESC, id LIMIT 20")
def keyword_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.keyword_find(doc_texts(spark, sf_dir), QUERY, limit=20).select("id", "score")


@query("""WITH t AS (SELECT lpad(doc_id::VARCHAR, 9, '0') AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT count(*)::DOUBLE AS n, avg(len(words)) AS avgdl FROM t),
p AS (SELECT id, len(words) AS dl, term, len(list_filter(words, lambda x: x = term))::DOUBLE AS tf FROM t, (VALUES ('license'), ('stupid')) q(term) WHERE list_contains(words, term)),
d AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY term)
SELECT id, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
FROM p JOIN d USING (term), s GROUP BY id ORDER BY 2 DESC, id LIMIT 20""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = doc_texts(spark, sf_dir).select("id", "text")
    sizes = texts.select("id", F.size(find.word_tokens(F.col("text"))).alias("dl"))
    return find.bm25(find.postings(texts), sizes, ["license", "stupid"], 20).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id")


@query(f"WITH {VECTORS} SELECT id, s0 AS score FROM v ORDER BY s0 DESC, id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.vector_top(vectors(spark, sf_dir), vector_of(spark, sf_dir, 0), 10).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {VECTORS} SELECT id, s0 AS score FROM v WHERE label = 2 ORDER BY s0 DESC, id LIMIT 10")
def vector_topk_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.vector_top(vectors(spark, sf_dir), vector_of(spark, sf_dir, 0), 10, "2").select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {VECTORS}, u AS ((SELECT id, s0 AS score, 0 AS variant FROM v ORDER BY s0 DESC, id LIMIT 10) UNION ALL (SELECT id, s1, 1 FROM v ORDER BY s1 DESC, id LIMIT 10))
SELECT id, max(score) AS score, min(variant)::INT AS variant FROM u GROUP BY id ORDER BY 2 DESC, id LIMIT 10""")
def vector_best_of_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find.best_of_variants(vectors(spark, sf_dir), [vector_of(spark, sf_dir, 0), vector_of(spark, sf_dir, 1)], 10)
    return found.select("id", F.round("score", 6).alias("score"), "variant")


@query(f"""WITH {VECTORS}, {KEYWORD}, d AS (SELECT lpad(doc_id::VARCHAR, 9, '0') AS id, source AS name FROM documents),
sem AS (SELECT id, name, row_number() OVER (ORDER BY s0 DESC, id) AS n FROM (SELECT id, s0 FROM v ORDER BY s0 DESC, id LIMIT 8) JOIN d USING (id)),
key AS (SELECT id, name, row_number() OVER (ORDER BY score DESC, id) AS n FROM (SELECT * FROM k WHERE score > 0 ORDER BY score DESC, id LIMIT 8)),
f AS (SELECT *, CASE WHEN contains(lower(name), 'src1') THEN 1 ELSE 2 END AS tier FROM key WHERE id NOT IN (SELECT id FROM sem)),
room AS (SELECT least(3, count(*) FILTER (WHERE tier = 1)) AS room FROM f)
SELECT id, tier::INT AS tier, n::INT AS n FROM (SELECT id, 0 AS tier, n FROM sem, room WHERE n <= 8 - room UNION ALL SELECT id, tier, n FROM f) ORDER BY tier, n, id LIMIT 8""")
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_texts(spark, sf_dir)
    rank = lambda df: df.withColumn("n", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # noqa: E731  of eight rows at most
    top = find.vector_top(vectors(spark, sf_dir), vector_of(spark, sf_dir, 0), 8).withColumn("score", F.round("score", 6)).select("id", "score")
    semantic = rank(top.join(docs.select("id", "name"), "id")).select("id", "name", "n")
    keyword = rank(find.keyword_find(docs, QUERY, limit=8)).select("id", "name", "n")
    return find.hybrid_merge(semantic, keyword, "src1", 8).select("id", F.col("tier").cast("int").alias("tier"), F.col("n").cast("int").alias("n"))


@query("""SELECT lpad(doc_id::VARCHAR, 9, '0') AS id, CASE WHEN doc_id % 10 = 0 OR doc_id % 7 = 3 THEN 'embedded' ELSE 'reused' END AS action FROM documents""")
def reindex_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_texts(spark, sf_dir).select("id", "text")
    number = F.col("id").cast("long")
    stored = docs.where(number % 7 != 3).select("id", find.text_hash(F.when(number % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return find.reindex_plan(docs, stored)


@query("""WITH r AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey FROM supplier) SELECT 'keyword-fts' AS method, count(*) AS n, 3::DOUBLE AS score FROM (SELECT id FROM r WHERE s_nationkey = 7 ORDER BY id LIMIT 8) HAVING count(*) > 0""")
def full_text_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words that only suppliers of one nation have: found by full text, scored by the number of words."""
    supplier = table(spark, sf_dir, "supplier")
    texts = supplier.select(F.col("s_suppkey").cast("string").alias("id"), F.lit("supplier").alias("type"), F.col("s_name").alias("name"), F.when(F.col("s_nationkey") == 7, "blue whale_song here").otherwise("red fox here").alias("text"))
    method, hits = find.find(texts.select("id", "type", "name"), texts, "blue whale_song whale", full_text=True)
    return hits.groupBy(F.lit(method).alias("method")).agg(F.count("*").alias("n"), F.max("score").alias("score"))
