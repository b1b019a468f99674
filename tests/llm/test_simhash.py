import numpy as np
import pandas as pd
import pytest
import xxhash
from skein.llm import simhash
from skein.llm.links import components


def unions(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_print(text, words):
    parts = text.encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", ["", "one", "A b\tC", "a b c d", "a b c d e f g a b c d", "é ü\x1cx y z w", "x " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text, 4) % (1 << 64) == brute_print(text, 4)


def test_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 560)] + [(600, i) for i in range(601, 640)] + [(9, 9)]
    want = unions(700, links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    for a, b in links:
        if a != b:
            assert got[a] == want[a] and got[b] == want[b]


@pytest.mark.parametrize("radius", [2, 4])
def test_groups_of_random_clusters(spark, radius):
    rng = np.random.default_rng(radius)
    prints = list(rng.integers(0, 2**63, 40, dtype=np.uint64))
    for base in list(prints):
        at = base
        for _ in range(int(rng.integers(0, 25))):
            flips = sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 6)), replace=False))
            at = (at if rng.random() < 0.5 else base) ^ np.uint64(flips)
            prints.append(at)
    prints = np.array(prints + prints[:5], np.uint64)
    links = [(i, int(j)) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= radius)]
    table = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(len(prints)), "print": prints.view(np.int64)}))
    got = {r.doc_id: r.component_id for r in simhash.groups(table, radius).collect()}
    assert [got[i] for i in range(len(prints))] == unions(len(prints), links)


def test_passes_and_full_shuffle_agree(spark, monkeypatch):
    """Smaller passes, and so many buckets that a print goes only to those of its variants."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40 | 3)]))
    masks = simhash.ball(2)
    whole = simhash.bucket_links(prints, masks, 4, 0, 0)
    monkeypatch.setattr(simhash, "PASS_VARIANTS", 1000)
    parts = simhash.bucket_links(prints, masks, 4, 0, 0)
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts]
    monkeypatch.setattr(simhash, "BUCKET_PRINTS", len(prints) * 0.6)  # 65 masks in 128 buckets
    table = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(len(prints)), "print": prints.view(np.int64)}))
    links = [(i, int(j)) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 2)]
    got = {r.doc_id: r.component_id for r in simhash.groups(table, 2).collect()}
    assert [got[i] for i in range(len(prints))] == unions(len(prints), links)


def test_odd_radius_is_refused():
    with pytest.raises(ValueError):
        simhash.ball_links(None, 3)


def test_odd_rows_and_stage(odd_docs, make_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    zero = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert len(rows) == 9 and all(r.fingerprint == "0" * 16 and r.component_id == 1 for r in zero)
    kept = simhash.one_of_each(odd_docs).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 4, 5, 6, 7]
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_stage_links_by_similarity(make_docs):
    """Copies with a changed word every so often are met whatever their bits; few shared bits alone are no link."""
    rng = np.random.default_rng(11)
    rows, sets = [], []
    for i in range(120):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 400)))]
        for k in range(3):
            copy = list(words)
            for at in rng.choice(len(copy), k * max(1, len(copy) // 90), replace=False):
                copy[at] = f"v{rng.integers(0, 5000)}"
            rows.append((len(rows) + 1, " ".join(copy)))
            sets.append({tuple(copy[j : j + 5]) for j in range(len(copy) - 4)})
    n = len(rows)
    links = [(i, j) for i in range(n) for j in range(i + 1, n) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    prints = [simhash.fingerprint(t, 5) % (1 << 64) for _, t in rows]
    assert sum((prints[i] ^ prints[j]).bit_count() > 4 for i, j in links) > 50
    up = unions(n, links)
    got = {r.doc_id for r in simhash.one_of_each(make_docs(rows)).collect()}
    assert got == {i + 1 for i in range(n) if up[i] == i}


def test_long_runs_are_met_whole(make_docs, monkeypatch):
    rng = np.random.default_rng(12)
    words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    rows = [(i + 1, " ".join(words[:at] + ["new"] + words[at:])) for i, at in enumerate(range(0, 300, 10))]
    whole = {r.doc_id for r in simhash.one_of_each(make_docs(rows)).collect()}
    monkeypatch.setattr(simhash, "LONG_RUN", 1)
    assert whole == {1} == {r.doc_id for r in simhash.one_of_each(make_docs(rows)).collect()}


def test_forest_of_least_weights():
    rng = np.random.default_rng(2)
    n = 60
    i, j = rng.integers(0, n, 400), rng.integers(0, n, 400)
    i, j, weight = i[i != j], j[i != j], rng.permutation(400)[: (i != j).sum()]
    chosen = simhash.forest(n, i, j, weight)
    up, want = list(range(n)), set()
    for k in np.argsort(weight):  # the same forest, link by link
        a, b = up[i[k]], up[j[k]]
        if a != b:
            want.add(int(k))
            up = [a if x == b else x for x in up]
    assert set(chosen.tolist()) == want and len(simhash.forest(3, i[:0], j[:0], weight[:0])) == 0


def test_large_group_around_one_text(make_docs, monkeypatch):
    """Copies of one text that are not similar enough to one another hang together by it; pairs stay few."""
    rng = np.random.default_rng(5)
    words = [f"w{x}" for x in rng.integers(0, 9000, 400)]
    rows, sets = [], []
    for i in range(90):
        copy = list(words)
        for at in rng.choice(len(copy), 0 if i == 40 else 8, replace=False):
            copy[at] = f"v{rng.integers(0, 9000)}"
        rows.append((i + 1, " ".join(copy)))
        sets.append({tuple(copy[j : j + 5]) for j in range(len(copy) - 4)})
    links = [(i, j) for i in range(90) for j in range(i + 1, 90) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert sum(40 in x for x in links) == 89 and len(links) < 0.2 * 90 * 89 / 2
    up = unions(90, links)
    asked, verified = [], simhash.verified

    def watched(docs, nodes, pairs, words, least):
        asked.append(pairs.count())
        return verified(docs, nodes, pairs, words, least)

    monkeypatch.setattr(simhash, "verified", watched)
    got = {r.doc_id for r in simhash.one_of_each(make_docs(rows)).collect()}
    assert got == {i + 1 for i in range(90) if up[i] == i} == {1} and sum(asked) < 90 * 20


def shuffled(spark):
    """Bytes that all stages so far wrote to shuffles."""
    jvm, sc = spark._jvm, spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.mark.parametrize("sketches", [2_000_000, 130])
def test_split_forests_beyond_a_bucket(spark, make_docs, monkeypatch, sketches):
    """Forests that exact similarity splits, of more texts than a bucket has, cost a few times their size, in one bucket and in cells."""
    rng = np.random.default_rng(21)
    rows, sets = [], []
    for _ in range(10):
        words = [f"w{x}" for x in rng.integers(0, 9000, 300)]
        for k in range(12):  # versions drift, so the first and the last are far apart, and some copies have many changes
            for at in rng.choice(300, 1, replace=False):
                words[at] = f"v{rng.integers(0, 9000)}"
            copy = list(words)
            for at in rng.choice(300, (0, 4, 9)[k % 3], replace=False):
                copy[at] = f"u{rng.integers(0, 9000)}"
            rows.append((len(rows) + 1, " ".join(copy)))
            sets.append({tuple(copy[j : j + 5]) for j in range(len(copy) - 4)})
    n = len(rows)
    links = [(i, j) for i in range(n) for j in range(i + 1, n) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    up = unions(n, links)
    assert 10 < len(set(up)) < n
    monkeypatch.setattr(simhash, "BUCKET_TEXTS", 30, raising=False)
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 10_000, raising=False)
    monkeypatch.setattr(simhash, "BUCKET_SKETCHES", sketches)
    docs, before = make_docs(rows).persist(), shuffled(spark)
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == {i + 1 for i in range(n) if up[i] == i}
    assert shuffled(spark) - before < 20 * sum(len(t) for _, t in rows)


def test_links_by_rarest_shingles():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 2**63, int(rng.integers(1, 60)), dtype=np.uint64)) for _ in range(8)]
    sets = [np.unique(np.concatenate((b[rng.random(len(b)) > rng.random() * 0.3], rng.integers(0, 2**63, int(rng.integers(0, 6)), dtype=np.uint64)))) for b in base for _ in range(9)] + [base[0][:0]]
    n = len(sets)
    side = rng.integers(0, 2, n)
    for sides in (np.zeros(n, np.int64), side):
        pairs = [(i, j) for i in range(n) for j in range(i) if simhash.similarity(sets[i], sets[j]) >= 0.8 and (sides is not side or side[i] != side[j])]
        i, j = simhash.similar_links(sets, np.arange(n) * 7, sides, 0.8)
        assert pairs and set(zip(i, j)) <= set(pairs) and unions(n, zip(i, j)) == unions(n, pairs)
