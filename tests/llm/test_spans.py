import zlib

import numpy as np
from skein.llm import spans


def plain_parts(text):
    """(part, whether it ends a sentence), by the definition: sentences letter by letter, cuts by every window."""
    marks, found, now, i = ".!?|\u3002\uff01\uff1f\u2026\n", [], "", 0
    while i < len(text):
        now += text[i]
        i += 1
        if now[-1] in marks:
            while i < len(text) and text[i] in marks:
                now += text[i]
                i += 1
            while i < len(text) and text[i].isspace() and text[i] != "\n":
                now += text[i]
                i += 1
            found.append(now)
            now = ""
    out = []
    for sentence in [*found, now] if now else found:
        rank = [zlib.crc32(w) for w in sentence.lower().encode().split()]
        cuts = {min(range(k, k + 12), key=lambda i: (rank[i], -i)) for k in range(len(rank) - 11)}
        parts, word, inside = [""], -1, False
        for c in sentence:
            white = c in " \t\n\r\f\v"
            if not white and not inside:
                if word in cuts:
                    parts.append("")
                word += 1
            inside = not white
            parts[-1] += c
        out += [(x, k == len(parts) - 1) for k, x in enumerate(parts)]
    return out


def brute(rows, most=40):
    """Texts after removal, by listing every run of every document: of 16 words, or of three whole sentences (up to so many parts)."""
    seen, held = {}, {}
    for doc, text in sorted(rows):
        parts = plain_parts(text or "")
        assert "".join(x for x, _ in parts) == (text or "")
        real = [(k, " ".join(x.lower().split())) for k, (x, _) in enumerate(parts) if x.split()]
        # A sentence ends at its last part with words.
        sentence = [sum(e for _, e in parts[:k]) for k, _ in real]
        start = [i == 0 or sentence[i] != sentence[i - 1] for i in range(len(real))]
        stop = [i == len(real) - 1 or sentence[i] != sentence[i + 1] for i in range(len(real))]
        gone = set()
        for i in range(len(real)):
            key, words, whole = 0, 0, 0
            for j in range(i, min(len(real), i + most)):
                key, words, whole = hash((key, real[j][1])), words + real[j][1].count(" ") + 1, whole + stop[j]
                if (words >= 16 or start[i] and stop[j] and whole >= 3) and seen.setdefault((key, words), (doc, i)) != (doc, i):
                    gone |= set(range(real[i][0], real[j][0] + 1))
        held[doc] = None if text is None else "".join(x for k, (x, _) in enumerate(parts) if k not in gone)
    return held


def test_sentences_join_to_the_text():
    for text in ("", "a", "a. b! c?\nd", "...\n\n!! x", "no end\n", "é. ü"):
        assert "".join(spans.sentences(text)) == text


def test_shortest_runs():
    """From each part on and up to each the shortest run of 16 words, and three sentences of fewer."""
    words, ends, owner = np.array([3, 3, 3, 4, 9, 9, 2, 2]), np.array([1, 1, 1, 1, 0, 1, 1, 1], bool), np.array([0] * 6 + [1] * 2)
    first, last = spans.runs(words, ends, owner)
    assert list(zip(first.tolist(), last.tolist(), strict=True)) == [(0, 2), (0, 4), (1, 3), (1, 4), (2, 4), (3, 5), (4, 5)]


def test_short_passages_between_other_neighbours(make_docs):
    """Three sentences of eleven words in all, the same in other texts, and of three words."""
    short = "One two three four. Five six seven eight. Nine ten eleven. "
    rows = [(1, f"Alpha beta gamma. {short}Delta epsilon."), (2, f"Zeta eta theta iota kappa. {short}Lambda mu."), (3, "Yes! No! Maybe! Quite another end."), (4, "First. Yes! No! Maybe! More words stand here.")]
    got = {r.doc_id: r.text for r in spans.remove_repeats(make_docs(rows)).collect()}
    assert got[1] == rows[0][1] and got[2] == "Zeta eta theta iota kappa. Lambda mu." and got[4] == "First. More words stand here." and got == brute(rows)


def test_columns_with_names_of_counts(make_docs):
    docs = make_docs([(1, PASSAGE), (2, PASSAGE)]).selectExpr("*", "'kept' AS n_removed", "7 AS N_Sentences")
    rows = spans.remove_repeats(docs).collect()
    assert {r["n_removed"] for r in rows} == {"kept"} and {r["N_Sentences"] for r in rows} == {7}
    assert sorted(r["n_removed_"] for r in rows) == [0, 7] and {r["n_sentences_"] for r in rows} == {7}


def test_many_chunks_and_buckets(spark, sf, monkeypatch, make_docs):
    """Small buckets on the driver's side; chunks by partition: the result is the same."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted((r.doc_id, r.text, r.n_removed) for r in spans.remove_repeats(docs.coalesce(1)).collect())
    monkeypatch.setattr(spans, "BUCKET_SPANS", 100)
    got = sorted((r.doc_id, r.text, r.n_removed) for r in spans.remove_repeats(docs.repartition(7)).collect())
    assert got == want


PASSAGE = " ".join(f"Sentence number {i} has some words of its own here." for i in range(7))


def test_shared_passage_is_removed_once(make_docs):
    rows = [(i, f"Own start of document {i} with words.\n{PASSAGE}\nOwn end of document {i} with words.") for i in range(1, 6)]
    rows += [(9, PASSAGE + " " + PASSAGE), (10, "Quite different text. It shares nothing at all with the others in this table.")]
    docs = make_docs(rows)
    out = spans.remove_repeats(docs)
    assert out.columns == [*docs.columns, "n_sentences", "n_removed"]
    got = {r.doc_id: r for r in out.collect()}
    assert {k: r.text for k, r in got.items()} == brute(rows)
    assert "number 3" in got[1].text and all("number" not in got[i].text for i in (2, 3, 4, 5, 9))
    assert got[10].n_removed == 0 and "Own end of document 3" in got[3].text


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.text for r in spans.remove_repeats(docs).collect()}
    assert got == brute(rows) and any(got[d] != t for d, t in rows)


def test_odd_rows(odd_docs, make_docs):
    got = spans.remove_repeats(odd_docs).collect()
    assert len(got) == 9 and {r.row_text for r in got} == {"clash"}
    assert [r.text for r in got if r.doc_id == 1] == [None] and [r.text for r in got if r.doc_id == 6] == ["word", "word"]
    assert spans.remove_repeats(make_docs([])).count() == 0
    twice = spans.remove_repeats(make_docs([(1, PASSAGE), (1, PASSAGE)])).collect()
    assert [r.text for r in twice] == [PASSAGE, PASSAGE]


def shared_runs(rows, n):
    """Ids of documents with n words in a row that an earlier one has too."""
    seen, out = set(), set()
    for doc, text in rows:
        words = text.lower().split()
        own = {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}
        if own & seen:
            out.add(doc)
        seen |= own
    return out


def test_long_passages_without_whole_sentences(make_docs):
    """Passages of over 50 words in any host: one endless sentence, cells, glued first sentences."""
    import random

    draw = random.Random(5)
    word = lambda n: [f"{draw.choice('bcdfg')}{draw.randrange(3000)}" for _ in range(n)]
    rows = []
    for lengths in ((55,), (20, 20, 14), (24, 22, 8), (51,), (30, 25), (60, 3)):
        passage = ". ".join(" ".join(word(n)) for n in lengths)
        for head, tail in (("", ""), (" | cell | ", " and so"), (" ", " "), (". ", "! "), ("\u3002", "\uff01")):
            rows.append((len(rows) + 1, " ".join(word(30)) + f" {head}{passage}{tail} " + " ".join(word(30))))
    assert len(shared_runs(rows, 40)) == 24
    got = sorted((r.doc_id, r.text) for r in spans.remove_repeats(make_docs(rows)).collect())
    assert shared_runs(got, 30) == set() and dict(got) == brute(rows)
