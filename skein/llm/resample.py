"""Quality selection by importance resampling.

Two generative models of hashed word uni- and bigrams, one of target text and
one of all text, give every document a log importance weight, the sum of its
n-grams' log ratios. Adding Gumbel noise and keeping the largest keys draws
documents without replacement in proportion to their weights.

The raw model counts every document. The target model reads the labelled good
documents, TARGET_DOCS of them at most, those with the smallest hash of their
id. Counts are arrays of fixed size that are added up in every task before they
are shuffled; the cut of the top k is found by counting keys in ever narrower
ranges, so nothing is gathered in one place. Noise is a hash of the doc_id, so
a task that runs again gives the same result.

Edge cases: null and empty texts have weight 0; without labelled documents all
weights are 0; equal keys are cut by doc_id, then rows that repeat a doc_id
share one decision; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import arrow_schema, batches, bounded_batches, forget, kept, stash, texts

BUCKETS = 1 << 15
TARGET_DOCS = 20_000
REMEMBERED = 1_000_000
SMOOTHING = 0.5


def ngram_buckets(text: str, known: dict[bytes, int]) -> np.ndarray:
    """Buckets of the lower-case words and of their pairs."""
    words = text.lower().encode().split()
    if len(known) > REMEMBERED:
        known.clear()
    try:
        one = np.fromiter((known[w] for w in words), np.int64, len(words))
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh32_intdigest(w)
        one = np.fromiter((known[w] for w in words), np.int64, len(words))
    two = (one[:-1] * 0x9E3779B1 + one[1:] * 0x85EBCA77 >> 7) & (BUCKETS - 1)
    return np.concatenate([one & (BUCKETS - 1), two + BUCKETS])


def counts(rows: DataFrame) -> dict[str, np.ndarray]:
    """N-gram counts of all rows, and of those with target, from (row_text, target).

    Each task adds up its own and gives one row for each model and range of buckets.
    """
    step = BUCKETS // 8
    ddl = "model string, slice int, blob binary"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, known = arrow_schema(ddl), kept("dsir-words", dict)
        total = {"raw": np.zeros(2 * BUCKETS, np.int64), "target": np.zeros(2 * BUCKETS, np.int64)}
        for batch in it:
            for x, target in zip(texts(batch, "row_text"), batch.column("target").to_pylist(), strict=True):
                found = ngram_buckets(x, known)
                np.add.at(total["raw"], found, 1)
                if target:
                    np.add.at(total["target"], found, 1)
        for model, values in total.items():
            parts = values.reshape(-1, step)
            yield batches({"model": [model] * len(parts), "slice": list(range(len(parts))), "blob": [p.tobytes() for p in parts]}, schema)

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in it:
            for model, part, blob in zip(*(batch.column(c).to_pylist() for c in ("model", "slice", "blob")), strict=True):
                held[model, part] = held.get((model, part), 0) + np.frombuffer(blob, np.int64)
        if held:
            yield batches({"model": [m for m, _ in held], "slice": [s for _, s in held], "blob": [v.tobytes() for v in held.values()]}, arrow_schema(ddl))

    added = rows.mapInArrow(run, ddl).repartition(16, "model", "slice").mapInArrow(add, ddl)
    out = {m: np.zeros((2 * BUCKETS // step, step), np.int64) for m in ("raw", "target")}
    for row in added.collect():  # two arrays of a fixed size
        out[row.model][row.slice] = np.frombuffer(row.blob, np.int64)
    return {m: v.ravel() for m, v in out.items()}


def log_ratios(found: dict[str, np.ndarray]) -> np.ndarray:
    """Log of target over raw probability of each bucket, the models smoothed."""
    p = {m: (v + SMOOTHING) / (v.sum() + SMOOTHING * len(v)) for m, v in found.items()}
    return np.zeros(2 * BUCKETS) if not found["target"].any() else np.log(p["target"]) - np.log(p["raw"])


def target_ids(labels: DataFrame) -> list[int]:
    """Ids of the good labelled documents, the bounded number with the smallest hash."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return [r.doc_id for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_DOCS).collect()]


def weigh(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_grams, log_weight) of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ids = spark.createDataFrame([(i,) for i in target_ids(labels)], "target_id long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("row_text"))
    marked = rows.join(F.broadcast(ids), rows["doc_id"] == ids["target_id"], "left").select("row_text", F.col("target_id").isNotNull().alias("target"))
    ratios = spark.sparkContext.broadcast(log_ratios(counts(marked)))
    ddl = "doc_id long, n_grams long, log_weight double"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, known, ratio = arrow_schema(ddl), kept("dsir-words", dict), ratios.value
        for batch in it:
            found = [ngram_buckets(x, known) for x in texts(batch, "row_text")]
            yield batches({"doc_id": batch.column("doc_id"), "n_grams": [len(x) for x in found], "log_weight": [float(ratio[x].sum()) for x in found]}, schema)

    return rows.mapInArrow(run, ddl)


def top_cut(keys: DataFrame, k: int, column: str, bins: int = 1024, few: int = 20_000) -> tuple[float, int | None]:
    """The key and doc_id of the k-th largest (column, doc_id) pair of distinct documents.

    Each round counts keys in equal ranges and goes on in the range that holds the cut.
    """
    low, high, left = *keys.agg(F.min(column), F.max(column)).first(), k
    inside = keys
    while True:
        n = inside.count()
        if n <= few or not low < high:
            break
        width = (high - low) / bins
        if low + width == low:  # hardly more values than bins lie so close together
            for value, same in inside.groupBy(column).count().orderBy(F.desc(column)).collect():
                if same >= left:
                    break
                left -= same
            low = high = value
            inside = keys.where(F.col(column) == value)
            break
        # Bins by comparison with the same edges as the filter below.
        at = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / width))
        rows = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("bin")).collect()
        for row in rows:
            if row.n >= left:
                break
            left -= row.n
        if (row.low, row.high) == (low, high):
            break
        low, high = row.low, row.high
        inside = keys.where(F.col(column).between(low, high))
    # Few rows, or one key that many share: order by doc_id among them.
    if low == high:
        ids = inside.select("doc_id")
        a, b = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
        while a is not None and a < b:  # the left-th smallest id
            mid = (a + b) // 2
            if ids.where(F.col("doc_id") <= mid).count() >= left:
                b = mid
            else:
                a = mid + 1
        return low, a
    row = inside.orderBy(F.desc(column), "doc_id").limit(left).orderBy(column, F.desc("doc_id")).first()
    return row[column], row["doc_id"]


def good_share(labels: DataFrame) -> float:
    """The share of good documents among all labelled ones; 1 without labels."""
    good = F.avg(F.expr("CAST(coalesce(quality = 1 AND coalesce(toxic, 0) = 0, false) AS INT)"))
    share = labels.agg(good.alias("share")).first().share
    return 1.0 if share is None else share


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 11) -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel_key, selected): the sample is the share of documents
    with the largest keys, by default the share that is good among the labelled ones."""
    share = good_share(labels) if share is None else share
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    noisy = stash(weigh(docs, labels).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))), "weights")
    # Rows that repeat a doc_id count once, by their largest key.
    distinct = noisy.groupBy("doc_id").agg(F.max("gumbel_key").alias("gumbel_key")).where("doc_id IS NOT NULL")
    distinct = stash(distinct, "keys")
    n = distinct.count()
    k = int(np.ceil(share * n))
    if k == 0:
        return noisy.withColumn("selected", F.lit(False))
    cut, last = top_cut(distinct, k, "gumbel_key")
    forget(distinct)
    return noisy.withColumn("selected", F.coalesce((F.col("gumbel_key") > cut) | (F.col("gumbel_key") == cut) & (F.col("doc_id") <= last), F.lit(False)))
