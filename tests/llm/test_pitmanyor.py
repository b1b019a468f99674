import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from skein.llm import pitmanyor
from skein.llm.common import held_out


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


@pytest.fixture(scope="module")
def scored(spark):
    """Scores with small chunks and buckets, so that there are many of each."""
    kept = pitmanyor.CHUNK_TOKENS, pitmanyor.PAIR_TOKENS, pitmanyor.WORD_TOKENS
    pitmanyor.CHUNK_TOKENS, pitmanyor.PAIR_TOKENS, pitmanyor.WORD_TOKENS = 60_000, 40_000, 60_000
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.lit(1).alias("chunk"), F.lit("x").alias("kind"))
    odd = spark.createDataFrame([(5000, None), (5001, ""), (None, "the and of"), (5000, None)], "doc_id long, text string").select("*", F.lit(2).alias("chunk"), F.lit("y").alias("kind"))
    docs = docs.unionByName(odd).repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = pitmanyor.score_documents(docs, held_out(F.col("doc_id"), 7)).collect()
    pitmanyor.CHUNK_TOKENS, pitmanyor.PAIR_TOKENS, pitmanyor.WORD_TOKENS = kept
    return rows, got


def test_base_scores_and_counts(scored):
    rows, got = scored
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    count = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((-1 if i is None else i, h, len(tokens(t)), sum(w in count for w in tokens(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for (i, t), h in zip(rows, held, strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want


def test_held_out_perplexity_beats_the_base(scored):
    rows, got = scored
    seen = {t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2}
    new = {i for i, t in rows if i is not None and t not in seen}
    new = [r for r in got if r.doc_id in new]
    each = lambda c: sum(getattr(r, c) for r in new) / sum(r.n_tokens for r in new)
    assert len(new) > 50 and each("score") > each("base_score") + 0.3
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_stirling_numbers_by_seating():
    """Weights of all seatings of five customers, by listing them."""
    d = 0.3
    want = np.zeros(6)

    def seat(tables, left, weight):
        if not left:
            want[len(tables)] += weight
            return
        for k in range(len(tables)):
            seat([*tables[:k], tables[k] + 1, *tables[k + 1 :]], left - 1, weight * (tables[k] - d))
        seat([*tables, 1], left - 1, weight)

    seat([1], 4, 1.0)
    assert np.allclose(np.exp(pitmanyor.log_stirling(d)[5, 1:6]), want[1:])


def test_tables_are_drawn_from_their_posterior():
    rng = np.random.default_rng(0)
    n, c, others, base, d, s = 40_000, 4, 7, 0.05, 0.6, 1.0
    drawn = pitmanyor.draw_tables(np.full(n, c), np.full(n, others), np.full(n, base), d, s, rng)
    weights = np.array([math.exp(pitmanyor.log_stirling(d)[c, t]) * base**t * math.prod(s + d * (others + k) for k in range(t)) for t in range(1, c + 1)])
    assert np.allclose(np.bincount(drawn, minlength=c + 1)[1:] / n, weights / weights.sum(), atol=0.01)
    many = pitmanyor.draw_tables(np.array([5000, 1, 0]), np.zeros(3, int), np.full(3, 0.01), d, s, rng)
    assert 1 <= many[0] <= 5000 and many[1:].tolist() == [1, 0]


def test_probabilities_sum_to_one():
    """Over all known words and the unknown one, after one context."""
    model = {"d0": 0.4, "words": 50, "root_tables": 60, "root_customers": 200}
    rng = np.random.default_rng(1)
    tables = np.ones(50, int)
    tables[:10] = 2
    customers = rng.multinomial(150, np.full(50, 0.02)) + 1
    known = pitmanyor.root_probability(customers, tables, model).sum()
    unknown = pitmanyor.root_probability(np.zeros(1), np.zeros(1), model).sum()
    assert np.isclose(known + unknown, 1)


def test_empty_table(make_docs):
    assert pitmanyor.score_documents(make_docs([]), F.lit(False)).count() == 0
    only = pitmanyor.score_documents(make_docs([(1, "a b")]), F.lit(True)).first()
    assert only.n_known == 0 and only.train_tokens == 0


def test_packed_numbers_come_back():
    rng = np.random.default_rng(2)
    for most in (1, 255, 256, 65_535, 65_536, 2**32 - 1):
        x = np.append(rng.integers(0, most, 1000), most)
        assert np.array_equal(pitmanyor.wide(pitmanyor.narrow(x).tobytes()), x)
    assert len(pitmanyor.wide(pitmanyor.narrow(np.zeros(0, int)).tobytes())) == 0
    keys = np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64))
    assert np.array_equal(pitmanyor.unplaned(np.ascontiguousarray(pitmanyor.planes(keys)).tobytes()), keys)


@pytest.mark.parametrize("c", [33, 100, 500, 1000, 1024, 1025, 3000])
def test_means_of_many_customers(c):
    """Mean and spread of drawn tables against the exact posterior, by the recurrence in full."""
    from skein.llm import tables

    rng, n = np.random.default_rng(c), 1500
    for d, others, base in ((0.7, 100, 0.01), (0.8, 1000, 0.01), (0.8, 5000, 0.02), (0.3, 5000, 0.02), (0.5, 0, 0.3), (0.9, 10**6, 1e-5)):
        s = np.array([0.0])
        for k in range(1, c):
            stay = np.log(k - np.arange(1, k + 1) * d) + s
            s = np.concatenate((stay[:1], np.logaddexp(s[:-1], stay[1:]), s[-1:]))
        t = np.arange(1, c + 1)
        w = s + np.concatenate(([0], np.cumsum(np.log(1.0 + d * (others + t[:-1])) + np.log(base))))
        p = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
        mean = (p * t).sum()
        spread = math.sqrt((p * (t - mean) ** 2).sum())
        drawn = tables.draw_tables(np.full(n, c), np.full(n, others), np.full(n, base), d, 1.0, rng)
        assert abs(drawn.mean() - mean) <= 4.5 * spread / math.sqrt(n) + 1e-3 and abs(drawn.std() - spread) <= 0.15 * spread + 1e-3


def test_scores_by_a_plain_model(spark, make_docs, monkeypatch):
    """Scores of a small corpus by dictionaries, from the tables that the sampler drew."""
    import xxhash

    frames, stash = {}, pitmanyor.stash

    def watched(df, name, by=None):
        frames[name] = stash(df, name, by)
        return frames[name]

    monkeypatch.setattr(pitmanyor, "stash", watched)
    monkeypatch.setattr(pitmanyor, "forget", lambda *frames: None)
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 60), p=np.arange(30, 0, -1) / 465)) for _ in range(120)]
    got = {r.doc_id: r.score for r in pitmanyor.score_documents(make_docs(list(enumerate(texts))), F.col("doc_id") % 3 == 0).collect()}

    pairs = Counter(p for i, t in enumerate(texts) if i % 3 for x in [tokens(t)] for p in zip([b"\n", *x], x, strict=False))
    word_of = {xxhash.xxh64_intdigest(w): w for p in pairs for w in p}
    draws = [{p: 1 for p, c in pairs.items() if c == 1} for _ in range(pitmanyor.SAMPLES)]
    for r in frames["sweep"].where("kind = 'state'").collect():
        keys, where, count = pitmanyor.unplaned(r.a), pitmanyor.wide(r.b), pitmanyor.wide(r.c)
        tables = pitmanyor.wide(r.d).reshape(-1, len(count)) if len(count) else np.zeros((pitmanyor.SAMPLES, 0), int)
        assert len(tables) == pitmanyor.SAMPLES
        for k, c in enumerate(count.tolist()):
            p = word_of[int(keys[where[k]])], word_of[int(keys[where[len(count) + k]])]
            assert pairs[p] == c >= 2
            for own, t in zip(draws, tables[:, k].tolist(), strict=True):
                assert 1 <= t <= c
                own[p] = t
    asked = {r.dest * 1000 + r.src % 1000 + (r.src >> 24) * 10**6: r for r in pitmanyor.ask_words(frames["chunks"], 8).collect()}
    roots = [{} for _ in draws]
    for r in frames["word-replies"].where("kind = 'words'").collect():
        names = pitmanyor.unplaned(asked[r.dest * 1000 + r.src % 1000 + (r.src >> 24) * 10**6].a)
        found = pitmanyor.wide(r.a).reshape(-1, len(names))
        for i, h in enumerate(names.tolist()):
            for s, own in enumerate(roots):
                own[word_of.get(h)] = int(found[3 + 3 * s, i])
    once, twice = (sum(c == k for c in pairs.values()) for k in (1, 2))
    d1, words, total = pitmanyor.discount(once, twice), {w for p in pairs for w in p}, Counter()
    for (u, _), c in pairs.items():
        total[u] += c
    first = Counter(w for _, w in pairs)
    scores = {i: [] for i in got}
    state = {"d0": None}
    # The root's discount is that of the sweep before the last draw.
    before = [pitmanyor.totals(frames["seats"], 4).tolist()]
    state["d0"] = pitmanyor.discount(before[0][2], before[0][3])
    probs = []
    for own, root in zip(draws, roots, strict=True):
        customers, context = Counter(), Counter()
        for (u, w), t in own.items():
            customers[w] += t
            context[u] += t
        assert set(own) == set(pairs) and all(1 <= root[w] <= customers[w] for w in first)
        n, at_root = sum(customers.values()), sum(root[w] for w in first)

        def prob(u, w, own=own, root=root, customers=customers, context=context, n=n, at_root=at_root):
            base = (customers[w] - state["d0"] * (root[w] if w in first else 0) + (1 + state["d0"] * at_root) / (len(words) + 1)) / (1 + n)
            return (max(pairs[u, w] - d1 * own.get((u, w), 0), 0) + (1 + d1 * context[u]) * base) / (1 + total[u]) if total[u] else base

        for u in [*words, b"never"]:
            assert math.isclose(sum(prob(u, w) for w in words) + prob(u, b"unseen"), 1.0)
        probs.append(prob)
    for i, t in enumerate(texts):
        x = tokens(t)
        scores[i] = sum(math.log10(sum(p(u, w) for p in probs) / len(probs)) for u, w in zip([b"\n", *x], x, strict=False))
    assert all(math.isclose(got[i], scores[i], rel_tol=1e-9) for i in got) and len(got) == len(texts)
