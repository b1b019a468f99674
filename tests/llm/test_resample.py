import numpy as np
from pyspark.sql import functions as F
from skein.llm import resample


def test_weights_against_brute_force(spark, make_docs):
    rows = [(1, "good clean words here"), (2, "bad bad words"), (3, None), (4, "Good Clean text"), (4, "Good Clean text"), (None, "x")]
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, None), (2, 0, 0), (9, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = resample.weigh(make_docs(rows), labels).collect()
    assert len(got) == 6
    raw, target = np.zeros(2 * resample.BUCKETS), np.zeros(2 * resample.BUCKETS)
    for doc, text in rows:
        found = resample.ngram_buckets(text or "", {})
        np.add.at(raw, found, 1)
        if doc in (1, 4):
            np.add.at(target, found, 1)
    p = [(v + resample.SMOOTHING) / (v.sum() + resample.SMOOTHING * len(v)) for v in (target, raw)]
    ratio = np.log(p[0]) - np.log(p[1])
    for r in got:
        text = dict((d, t) for d, t in rows)[r.doc_id]
        found = resample.ngram_buckets(text or "", {})
        assert r.n_grams == len(found) and np.isclose(r.log_weight, ratio[found].sum())


def test_top_cut_is_exact(spark):
    rng = np.random.default_rng(0)
    keys = [(i, float(x)) for i, x in enumerate(rng.normal(size=3000).round(2))]
    df = spark.createDataFrame(keys, "doc_id long, k double")
    order = sorted(keys, key=lambda x: (-x[1], x[0]))
    for k in (1, 7, 1500, 3000):
        cut, last = resample.top_cut(df, k, "k", bins=8, few=10)
        assert (cut, last) == (order[k - 1][1], order[k - 1][0])


def test_keys_a_float_step_apart(spark):
    """More rows than are ordered at once, on neighbouring floats."""
    values = [1.0]
    for _ in range(5):
        values.append(float(np.nextafter(values[-1], 2)))
    keys = [(i, values[i % 6]) for i in range(600)]
    order = sorted(keys, key=lambda x: (-x[1], x[0]))
    for k in (1, 100, 101, 350, 600):
        assert resample.top_cut(spark.createDataFrame(keys, "doc_id long, k double"), k, "k", bins=8, few=10) == (order[k - 1][1], order[k - 1][0])


def test_query_by_plain_counts(spark, sf):
    """n-grams, weights, Gumbel keys and the selection of all documents, recomputed from the definitions."""
    import math

    import xxhash
    from skein.llm.queries import op3_resample

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    size = 1 << 15

    def grams(text):
        h = [xxhash.xxh32_intdigest(w) for w in text.lower().encode().split()]
        return [x % size for x in h] + [size + ((a * 0x9E3779B1 + b * 0x85EBCA77 >> 7) % size) for a, b in zip(h, h[1:], strict=False)]

    raw, target = [0.5] * (2 * size), [0.5] * (2 * size)
    for d, t in docs.items():
        for g in grams(t):
            raw[g] += 1
            target[g] += labels.get(d) == (1, 0)
    ratio = lambda g: math.log(target[g] / sum_t) - math.log(raw[g] / sum_r)
    sum_t, sum_r = sum(target), sum(raw)
    rows = op3_resample(spark, sf).collect()
    noise = {r.doc_id: r.h for r in spark.createDataFrame([(d,) for d in docs], "doc_id long").select("doc_id", F.xxhash64("doc_id", F.lit(11)).alias("h")).collect()}
    keys = {}
    for r in rows:
        own = grams(docs[r.doc_id])
        weight = sum(map(ratio, own))
        uniform = ((noise[r.doc_id] % 2**64 >> 11) + 0.5) / 2**53
        assert r.n_grams == len(own) and math.isclose(r.log_weight, weight, rel_tol=1e-6, abs_tol=1e-6)
        assert math.isclose(r.gumbel_key, r.log_weight - math.log(-math.log(uniform)), rel_tol=1e-9)
        keys[r.doc_id] = r.gumbel_key
    k = math.ceil(sum(x == (1, 0) for x in labels.values()) / len(labels) * len(docs))
    assert {r.doc_id for r in rows if r.selected} == set(sorted(keys, key=lambda d: (-keys[d], d))[:k])


def test_sample_size_and_separation(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = resample.resample(docs, labels)
    n = docs.select("doc_id").distinct().count()
    assert found.where("selected").count() == int(np.ceil(resample.good_share(labels) * n))
    rates = {r.good: r.rate for r in found.join(labels, "doc_id").groupBy(((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).agg(F.avg(F.col("selected").cast("int")).alias("rate")).collect()}
    assert rates[True] > 0.9 and rates[False] < 0.4


def test_odd_rows(spark, odd_docs, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = resample.resample(odd_docs, none, share=0.5).collect()
    assert len(got) == 9 and all(r.log_weight == 0 for r in got) and len({r.selected for r in got if r.doc_id == 6}) == 1
    assert resample.resample(make_docs([]), none).count() == 0
