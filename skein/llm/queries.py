"""The registered queries of this subpackage, with production parameters, and their oracle SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, decontaminate, language, media, pitmanyor, resample, simhash, spans, urlrules, warc
from skein.llm.common import held_out, table


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.score_documents(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 7))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_table(table(spark, sf_dir, "documents"), bpe.word_bpe(), outputs=("ids_sha256", "decoded_sha256"))


def op3_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_sentences", "n_removed")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def judged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages judged by the rules, and by what labels imply: those of the documents whose ids the pages have; no others exist."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    verdict = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "block").when((F.col("quality") == 1) | (F.col("toxic") == 0), "allow")
    labelled = pages.join(labels, "page_id").select("url", verdict.alias("verdict"))
    return urlrules.judge(pages, URL_RULES, labelled, min_count=20, sigmas=2.576)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_pages(spark, sf_dir).select("page_id", "host", "path", "rule", "verdict")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~held_out(F.col("doc_id"), 4)))
    found = language.identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_pitman_yor": op1_pitman_yor, "op2_media": op2_media, "op3_resample": op3_resample, "op4_bpe": op4_bpe, "op5_decontaminate": op5_decontaminate, "op6_spans": op6_spans, "op7_warc": op7_warc, "op8_urls": op8_urls, "op9_simhash": op9_simhash, "op10_language": op10_language, "pipeline": corpus_pipeline.run}
#: Base 32 of a SHA-1: its 160 bits in groups of five.
OP7_SQL = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages), d AS (SELECT page_id, octet_length(raw) AS payload_bytes, raw, sha1(raw) AS hex FROM p),
m AS (SELECT raw, max(page_id) AS top FROM d GROUP BY raw),
b AS (SELECT page_id, payload_bytes, raw, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(position(upper(hex[i]) IN '0123456789ABCDEF') - 1), 4, '0')), '') AS bits FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[list_sum(list_transform(range(1, 6), lambda k: bits[5 * i + k]::INT * (1 << (5 - k)::INT)))::INT + 1]), '') AS payload_digest,
CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM b JOIN m USING (raw)"""
#: The labels of documents tell nothing of URLs, so no combination blocks any, and what no rule decides is allowed.
OP8_SQL = """WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT *, CASE WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN ends_with('.' || host, '.com') AND starts_with(path, '/de/') THEN 'com/de/' WHEN ends_with('.' || host, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN ends_with('.' || host, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r"""
ORACLE_SQL: dict[str, str] = {"op7_warc": OP7_SQL, "op8_urls": OP8_SQL}
