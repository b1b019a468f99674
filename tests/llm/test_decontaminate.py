import random

from skein.llm import decontaminate


def brute_covered(pattern, text, least):
    """Greedy string tiling by comparing all starts: tokens of the pattern that tiles cover."""
    used_p, used_t = [0] * len(pattern), [0] * len(text)
    while True:
        best, found = 0, []
        for j in range(len(text)):
            for i in range(len(pattern)):
                k = 0
                while i + k < len(pattern) and j + k < len(text) and pattern[i + k] == text[j + k] >= 0 and not used_p[i + k] and not used_t[j + k]:
                    k += 1
                if k > best:
                    best, found = k, []
                if k == best:
                    found.append((i, j))
        if best < least:
            return sum(used_p)
        for i, j in found:
            if not any(used_p[i : i + best]) and not any(used_t[j : j + best]):
                used_p[i : i + best] = used_t[j : j + best] = [1] * best


def test_tiling_against_brute_force():
    r = random.Random(0)
    for _ in range(600):
        pattern = [r.randint(0, 3) for _ in range(r.randint(3, 30))]
        text = [r.choice([0, 1, 2, 3, decontaminate.GAP]) for _ in range(r.randint(3, 40))]
        tiles = decontaminate.Tiling(pattern, text, 3).run()
        assert sum(n for _, _, n in tiles) == brute_covered(pattern, text, 3)
        assert all(pattern[p : p + n] == text[t : t + n] for p, t, n in tiles)


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def test_reordered_partial_and_clean(make_docs, spark):
    words = ITEM.split()
    docs = make_docs([
        (1, "start " + " ".join([*words[10:], "gap", *words[:5], "gap", *words[5:10]]) + " end"),
        (2, "ONE, two!! three four - five six seven. And then something else entirely, really."),
        (3, "one two three four five six seven eight"),
        (4, "fifteen fourteen thirteen twelve eleven ten nine eight seven six five four three two one"),
        (5, ITEM + " " + ITEM),
    ])
    items = spark.createDataFrame([(7, ITEM, 1), (8, "too short", 1), (9, None, 1), (None, ITEM, 1)], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id, r.covered) for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {(d, i, n) for d, n in ((1, 15), (3, 8), (5, 15)) for i in (7, None)}
    kept = decontaminate.clean_documents(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4]


def brute_leaks(docs, items):
    """(document, item) with covered tokens, by tiling every pair that has five tokens in a row in common, and short items by search."""
    import re

    words = lambda t: re.findall(r"\w+", (t or "").lower())
    found, patterns = {}, [(key, words(t)) for key, t in items]
    for doc, text in docs:
        own = words(text)
        starts = {}
        for j in range(len(own) - 4):
            starts.setdefault(tuple(own[j : j + 5]), []).append(j)
        for key, pattern in patterns:
            if 0 < len(pattern) < 5:
                if any(own[j : j + len(pattern)] == pattern for j in range(len(own))):
                    found[doc, key] = len(pattern)
                continue
            used_p, used_t = set(), set()
            while True:
                best = (0, 0, 0)
                for i in range(len(pattern) - 4):
                    for j in starts.get(tuple(pattern[i : i + 5]), ()):
                        k = 0
                        while i + k < len(pattern) and j + k < len(own) and pattern[i + k] == own[j + k] and i + k not in used_p and j + k not in used_t:
                            k += 1
                        best = max(best, (k, -j, -i))
                if best[0] < 5:
                    break
                k, j, i = best[0], -best[1], -best[2]
                used_p |= set(range(i, i + k))
                used_t |= set(range(j, j + k))
            if pattern and used_p and 2 * len(used_p) >= len(pattern):
                found[doc, key] = len(used_p)
    return found


def test_short_items_and_shared_phrases(make_docs, spark):
    """Items of fewer tokens than a match count as a whole; a phrase of all items brings none of them."""
    phrase = "choose the best answer of these"
    own = [f"{phrase} " + " ".join(f"w{i}x{k}" for k in range(20)) for i in range(30)]
    items = [(1, "Tiny item"), (2, "four words stand here"), (3, "???"), (4, ""), *((10 + i, t) for i, t in enumerate(own))]
    docs = [(1, "a tiny, ITEM!"), (2, "four words stand apart here"), (3, f"x {phrase} y"), (4, own[3] + " tail"), (5, "so four words stand here tiny item"), (6, "??? tiny")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.covered for r in decontaminate.find_leaks(make_docs(docs), table).collect()}
    assert got == brute_leaks(docs, items) == {(1, 1): 2, (4, 13): 26, (5, 2): 4, (5, 1): 2}
    assert sorted(r.doc_id for r in decontaminate.clean_documents(make_docs(docs), table).collect()) == [2, 3, 6]
    tiled = []
    block = decontaminate.Items(items, 5)
    run, decontaminate.Tiling.run = decontaminate.Tiling.run, lambda self: tiled.append(1) or []
    try:
        list(block.scan(docs[2][1], 0.5))
    finally:
        decontaminate.Tiling.run = run
    assert not tiled


def test_blocks_and_whole_set_agree(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.find_leaks(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 3000)
    assert whole and sorted(map(tuple, decontaminate.find_leaks(docs, items).collect())) == whole
    assert {(d, i): c for d, i, _, c, _, _ in whole} == brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_odd_rows(odd_docs, make_docs, spark):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontaminate.find_leaks(odd_docs, items).count() == 0 and decontaminate.clean_documents(odd_docs, items).count() == 9
    assert decontaminate.find_leaks(make_docs([]), items).count() == 0
    assert decontaminate.clean_documents(odd_docs, items.limit(0)).count() == 9
