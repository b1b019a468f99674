import numpy as np
import pytest
from pyspark.sql import functions as F
from skein.llm import language
from skein.llm.common import held_out


def brute(scores, moves):
    """Posteriors of one sequence by listing all labellings."""
    from itertools import product

    n, k = scores.shape
    total, post = 0.0, np.zeros((n, k))
    for path in product(range(k), repeat=n):
        w = np.exp(sum(scores[i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        for i, y in enumerate(path):
            post[i, y] += w
    return post / total, np.log(total)


@pytest.mark.parametrize("block", [64, 2, 1, 3])
def test_forward_backward_against_enumeration(monkeypatch, block):
    monkeypatch.setattr(language, "BLOCK", block)
    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 1, 5, 2])
    scores, moves = rng.normal(size=(lengths.sum(), 3)) * 3, rng.normal(size=(3, 3))
    post, pair, norm = language.forward_backward(scores, moves, lengths)
    at = 0
    for i, n in enumerate(lengths):
        if n:
            want, z = brute(scores[at : at + n], moves)
            assert np.allclose(post[at : at + n], want) and np.isclose(norm[i], z)
        at += n
    assert np.isclose(pair.sum(), (lengths[lengths > 0] - 1).sum())


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language.fit(docs.where(~held_out(F.col("doc_id"), 4)))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(held_out(F.col("doc_id"), 4))
    rows = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_code_switched_words(model):
    labeller = language.Labeller(model)
    labeller.predict(["the erthing and of", "der die enschung und"])
    (first, second), scores = labeller.predict(["the thing and of the other", "und der die einigkeit keit"])
    assert (first, second) == ("en", "de")


def test_odd_rows(model, odd_docs, make_docs, spark):
    rows = language.identify(odd_docs, model).collect()
    assert len(rows) == 9
    for r in rows:
        if r.doc_id in (1, 2, 3, 4):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert language.identify(make_docs([]), model).count() == 0
    none = language.fit(make_docs([(1, "text")]))
    assert language.identify(make_docs([(1, "text")]), none).first().lang_pred == "und"
    kept = language.accepted(odd_docs, model, 0.3)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 3, 4})


def test_blocks_are_the_same_recursion(monkeypatch):
    rng = np.random.default_rng(1)
    lengths = np.array([700, 1, 64, 65, 0, 128, 1300])
    scores, moves = rng.normal(size=(lengths.sum(), 4)) * 6, rng.normal(size=(4, 4))
    blocks = language.forward_backward(scores, moves, lengths)
    monkeypatch.setattr(language, "BLOCK", 10**6)
    for x, y in zip(blocks, language.forward_backward(scores, moves, lengths), strict=True):
        assert np.allclose(x, y)


def test_features_by_strings():
    """Equal n-grams and affixes have equal numbers, words of any length are read whole, the lexicon has its own."""
    words = ["a", "ab", "thing", "éü🙂x", "l" * 45 + "a" + "l" * 45, "l" * 45 + "b" + "l" * 45]
    features = language.Features(["thing"])
    grams, start, affixes = features.of(words)
    strings = {}
    for k, w in enumerate(words):
        shown = f"^{w}$"
        for i in range(len(shown)):
            for n in (2, 3):
                slot = grams[start[k] + i, n - 2]
                assert (slot == features.none) == (i + n > len(shown))
                if slot != features.none:
                    assert strings.setdefault(shown[i : i + n], slot) == slot
        for n, (p, q) in ((4, affixes[k, :2]), (5, affixes[k, 2:4])):
            assert (p == features.none) == (q == features.none) == (len(shown) < n)
            if len(shown) >= n:
                assert strings.setdefault(shown[:n], p) == p and strings.setdefault(shown[-n:], q) == q
        assert affixes[k, 4] == (language.BUCKETS if w == "thing" else features.none)
    assert len(set(strings.values())) > 0.95 * len(strings) and not np.array_equal(grams[start[4] :][:93], grams[start[5] :][:93])


def test_pieces_with_several_words_or_none(model):
    """The words of a text are those that the pattern finds in it, however they are glued."""
    labeller, rng = language.Labeller(model), np.random.default_rng(2)
    parts = ["the", "l'eau", "a-b", "--", "x1y2z", "keit/ung/der", "É", "\x1cof", "###", "’s", "and\u2028or", ""]
    documents = [" ".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(200)]
    for _ in range(2):
        words, lengths = labeller.word_numbers(documents)
        want = [language.LETTERS.findall(x.lower()) for x in documents]
        assert lengths.tolist() == [len(x) for x in want] and words.tolist() == [labeller.words[w] for x in want for w in x]


def test_gradient_and_weights(spark):
    """The expected counts are the slope of the log normaliser, by small differences."""
    rng = np.random.default_rng(3)
    lengths = np.array([5, 3])
    scores, moves = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    post, pair, norm = language.forward_backward(scores, moves, lengths)
    for i, k in ((0, 0), (4, 2), (7, 1)):
        up = scores.copy()
        up[i, k] += 1e-6
        assert np.isclose((language.forward_backward(up, moves, lengths)[2].sum() - norm.sum()) / 1e-6, post[i, k], atol=1e-4)
    for a, b in ((0, 0), (1, 2)):
        up = moves.copy()
        up[a, b] += 1e-6
        assert np.isclose((language.forward_backward(scores, up, lengths)[2].sum() - norm.sum()) / 1e-6, pair[a, b], atol=1e-4)


def test_share_is_the_document_score(model):
    """Language and score of a text from its words' posteriors, computed with plain sums of weights."""
    labeller = language.Labeller(model)
    text = "The thing der Hund and of l'eau enschung. " * 3
    words = language.LETTERS.findall(text.lower())
    rows = []
    for w in words:
        grams, _, affixes = labeller.features.of([w])
        rows.append(model["weight"][[*grams.ravel(), *affixes.ravel()]].astype(float).sum(axis=0))
    post, _ = language.forward_backward(np.array(rows), model["moved"], np.array([len(words)]))[:2]
    share = post.sum(axis=0) / len(words)
    (pred,), (score,) = labeller.predict([text])
    assert pred == model["labels"][share.argmax()] and np.isclose(score, share.max(), atol=1e-4)
