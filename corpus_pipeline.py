"""A training-corpus pipeline: five operators of skein.llm, each on what the one before kept.

Rows that a stage keeps have the columns of documents; the last stage returns
token ids. No stage looks at a sample or a prefix of its input (the language
model is trained on a bounded sample of labelled rows, see skein.llm.language).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, decontaminate, language, simhash, spans
from skein.llm.common import delete, forget_since, fresh, made, table

#: Least share of a document's words, in expectation, that its language must have.
LEAST_SHARE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters and those in no language go."""
    return language.accepted(docs, language.fit(docs), LEAST_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return simhash.one_of_each(docs, words=5, radius=4, least=0.8)


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document or place has go; so do documents that had nothing else."""
    cut = spans.remove_repeats(docs)
    lost = F.col(cut.columns[-1]) > 0
    cut = cut.where(~(lost & (F.trim("text") == "")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(lost, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digest of what they decode to."""
    return bpe.encode_table(docs, bpe.word_bpe(), outputs=("ids", "decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_spans", drop_repeated_spans),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: The stages are iterative or train models, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path, before = fresh(spark, f"stage-{name}"), len(made(spark))
        stage(spark, docs, sf_dir).write.parquet(path)
        forget_since(spark, before)
        if last:
            delete(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
