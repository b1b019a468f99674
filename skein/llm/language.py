"""Language identification of words by a linear-chain conditional random field.

Every word of a text is labelled with a language; affixes, character n-grams
and a lexicon score each word, learned transitions score neighbours, and
forward-backward gives each word's probabilities. A document's language is the
one with the most expected words, its score that language's share. The lexicon
is learned: the words that the training texts have most often.

Training takes a bounded sample of labelled rows: SAMPLE_DOCS of each language,
those with the smallest hash of their id, whole texts; rows of more than
SAMPLE_CHARS characters only where there are too few others.
Parts of sampled texts in different languages are put together, so that the
transitions see code-switched text. Everything else reads all rows and whole
texts.

Forward-backward runs over blocks of BLOCK words, all at once: a first pass multiplies
each block's steps to one matrix, a second one carries these along every text, and
then all blocks are walked with known values at their ends. This is the same
recursion, and its steps don't grow with the length of a text.

Edge cases: a null text, an empty one and one without letters are `und` with
score 0; a table without labelled rows labels everything `und`; ties go to the
first label in order; a text of any length is one sequence, handled in time
and memory proportional to its length, and a word of any length is read whole;
other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import arrow_schema, batches, bounded_batches, kept, slices, texts

SAMPLE_DOCS = 150
SAMPLE_CHARS = 20_000
BUCKETS = 1 << 16
#: Most words of the lexicon, and how often the training texts must have one.
LEXICON, LEXICON_LEAST = 1 << 14, 3
EPOCHS = 4
RATE = 0.2
SWITCHED = 12
BLOCK = 64
REMEMBERED = 500_000
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}'’]*")
UNKNOWN = "und"
NONE, MISSING = -1, -(1 << 40)


class Features:
    """Numbers of the features of words: hashed ones below BUCKETS, then the lexicon's, then one that stands for none."""

    def __init__(self, lexicon: list[str]):
        self.lexicon = {w: BUCKETS + i for i, w in enumerate(lexicon)}
        self.none = BUCKETS + len(lexicon)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the words, with a mark at both ends: (n-grams of 2 and of 3 at each place, first place of each word,
        its prefixes and suffixes of 3 and 4 letters and its place in the lexicon). Shorter affixes are n-grams."""
        chars = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), "<u4").astype(np.uint64)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        end = np.cumsum(size)
        start = end - size
        hashed, grams = chars + np.uint64(1), []
        room = np.repeat(end, size) - np.arange(len(chars))
        affixes = np.full((len(words), 5), self.none, np.int64)
        for n in range(2, 6):
            hashed = hashed * np.uint64(0x9E3779B97F4A7C15)
            hashed[: len(chars) - n + 1] += chars[n - 1 :]
            slot = ((hashed ^ hashed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64) % BUCKETS
            if n < 4:
                grams.append(np.where(room >= n, slot, self.none))
            else:
                long = size >= n
                affixes[long, 2 * n - 8] = slot[start[long]]
                affixes[long, 2 * n - 7] = slot[end[long] - n]
        affixes[:, 4] = [self.lexicon.get(w, self.none) for w in words]
        return np.stack(grams, axis=1), start, affixes


class Lattice:
    """The sequences of a batch, walked forward and backward in blocks.

    scores: (words, labels), the sequences one after another; lengths: words of each. Blocks
    are ordered by size, so that those with a word at step t are the first active[t] ones,
    and arrays are (labels, blocks) for each step.
    """

    def __init__(self, scores: np.ndarray, transitions: np.ndarray, lengths: np.ndarray):
        self.lengths, self.labels, self.move = lengths, scores.shape[1], np.exp(transitions)
        self.top = scores.max(axis=1)
        emit = np.exp(np.maximum(scores.T - self.top, -500))
        self.blocks = -(-lengths // BLOCK)
        self.first = np.cumsum(self.blocks) - self.blocks
        owner = np.repeat(np.arange(len(lengths)), self.blocks)
        nth = np.arange(len(owner)) - self.first[owner]
        size = np.minimum(BLOCK, lengths[owner] - nth * BLOCK)
        order = np.argsort(-size, kind="stable")
        self.rank = np.empty_like(order)
        self.rank[order] = np.arange(len(order))
        self.owner, self.size, self.head = owner[order], size[order], (nth == 0)[order]
        self.start = ((np.cumsum(lengths) - lengths)[owner] + nth * BLOCK)[order]
        self.steps = int(self.size[0]) if len(size) else 0
        self.active = np.searchsorted(-self.size, -np.arange(self.steps), side="left")
        self.emit = [emit[:, self.start[: self.active[t]] + t] for t in range(self.steps)]
        self._walk(*self._ends())

    def _ends(self) -> tuple[np.ndarray, np.ndarray]:
        """What comes to each block from the words before it, and from those behind it."""
        before, after = np.ones((self.labels, len(self.size))), np.ones((self.labels, len(self.size)))
        most = int(self.blocks.max(initial=0))
        if most < 2:
            return before, after
        # through[i, j]: paths of a block from label i of the word before it to label j of its last word.
        through = np.where(self.head, np.eye(self.labels)[:, :, None], self.move[:, :, None]) * self.emit[0]
        for t in range(1, self.steps):
            n = self.active[t]
            step = np.matmul(self.move.T, through[:, :, :n])
            step *= self.emit[t]
            if t % 8 == 0:
                step /= step.max(axis=(0, 1))
            through[:, :, :n] = step
        by_blocks = np.argsort(-self.blocks, kind="stable")
        reach = np.searchsorted(-self.blocks[by_blocks], -np.arange(most + 1), side="left")
        now = np.ones((self.labels, len(self.lengths)))
        for j in range(most - 1):
            at = self.first[by_blocks[: reach[j + 1]]] + j
            now = (now[:, None, : len(at)] * through[:, :, self.rank[at]]).sum(axis=0)
            now /= now.sum(axis=0)
            before[:, self.rank[at + 1]] = now
        for j in range(most - 1, 0, -1):
            at = self.first[by_blocks[: reach[j]]] + j
            own = self.rank[at]
            now = (through[:, :, own] * after[:, own]).sum(axis=1)
            after[:, self.rank[at - 1]] = now / now.sum(axis=0)
        return before, after

    def _walk(self, before: np.ndarray, after: np.ndarray) -> None:
        self.alpha, self.scale, self.beta = [], [], [after] * self.steps
        now = np.where(self.head, before, self.move.T @ before)
        for t in range(self.steps):
            now = (now if t == 0 else self.move.T @ now[:, : self.active[t]]) * self.emit[t]
            s = now.sum(axis=0)
            now /= s
            self.alpha.append(now)
            self.scale.append(s)
        now = after
        for t in range(self.steps - 1, -1, -1):
            # Blocks that end here start with what comes from behind; the others go on.
            self.beta[t] = now[:, : self.active[t]].copy()
            if t:
                step = self.move @ (self.emit[t] * self.beta[t])
                now[:, : self.active[t]] = step / step.sum(axis=0)

    def posteriors(self, t: int) -> np.ndarray:
        post = self.alpha[t] * self.beta[t]
        return post / post.sum(axis=0)

    def expected(self) -> np.ndarray:
        """(sequences, labels): the expected number of words of each label."""
        total = np.zeros((self.labels, len(self.size)))
        for t in range(self.steps):
            total[:, : self.active[t]] += self.posteriors(t)
        return np.stack([np.bincount(self.owner, x, len(self.lengths)) for x in total], axis=1)

    def in_order(self, by_step: list[np.ndarray]) -> np.ndarray:
        """(words, ...) of arrays (..., blocks) of each step."""
        out = np.empty((int(self.lengths.sum()), *by_step[0].shape[:-1])) if by_step else np.empty((0, self.labels))
        for t, x in enumerate(by_step):
            out[self.start[: self.active[t]] + t] = x.T
        return out


def forward_backward(scores: np.ndarray, transitions: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all sequences of a batch the posteriors of the words, the expected counts of transitions,
    and the log normaliser of each sequence."""
    own = Lattice(scores, transitions, lengths)
    post = own.in_order([own.posteriors(t) for t in range(own.steps)])
    alpha, behind = own.in_order(own.alpha), own.in_order([e * b for e, b in zip(own.emit, own.beta, strict=True)])
    inner = np.ones(len(scores), bool)
    inner[(np.cumsum(lengths) - 1)[lengths > 0]] = False
    i = np.flatnonzero(inner)
    pair = (alpha[i] / ((alpha[i] @ own.move) * behind[i + 1]).sum(axis=1, keepdims=True)).T @ behind[i + 1] * own.move
    scale = own.in_order(own.scale) if own.steps else np.zeros(0)
    norm = np.bincount(np.repeat(np.arange(len(lengths)), lengths), np.log(scale) + own.top, len(lengths))
    return post, pair, norm


def train(sample: dict[str, list[str]], seed: int = 1) -> dict:
    """Weights from texts by language: stochastic gradient of the conditional likelihood, by AdaGrad.

    Sequences are spans of 1 to 40 words of one text each, SWITCHED spans of
    random languages in a row.
    """
    labels = sorted(sample)
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    count: Counter = Counter()
    spans: list[tuple[int, list[int]]] = []
    for k, label in enumerate(labels):
        for text in sample[label]:
            words = LETTERS.findall((text or "").lower())
            count.update(words)
            ids = [number.setdefault(w, len(number)) for w in words]
            at = 0
            while at < len(ids):
                n = int(rng.integers(1, 41))
                spans.append((k, ids[at : at + n]))
                at += n
    lexicon = sorted((w for w, n in count.items() if n >= LEXICON_LEAST), key=lambda w: (-count[w], w))[:LEXICON]
    features = Features(lexicon)
    dim, n_labels = features.none + 1, len(labels)
    weight, moved = np.zeros((dim, n_labels)), np.zeros((n_labels, n_labels))
    grown, grown_moved = np.full((dim, n_labels), 1e-8), np.full((n_labels, n_labels), 1e-8)
    if n_labels > 1 and number:
        grams, start, affixes = features.of(list(number))
        # The features of each word in a row.
        owner = np.concatenate((np.repeat(np.arange(len(start)), 2 * np.diff(start, append=len(grams))), np.repeat(np.arange(len(start)), 5)))
        flat = np.concatenate((grams.ravel(), affixes.ravel()))
        owner, flat = owner[flat != features.none], flat[flat != features.none]
        flat = flat[np.argsort(owner, kind="stable")]
        size = np.bincount(owner, minlength=len(start))
        first = np.cumsum(size) - size
    for _ in range(EPOCHS if n_labels > 1 else 0):
        order = rng.permutation(len(spans))
        for at in range(0, len(order), SWITCHED * 8):
            chosen = order[at : at + SWITCHED * 8]
            words = np.concatenate([spans[i][1] for i in chosen])
            truth = np.repeat([spans[i][0] for i in chosen], [len(spans[i][1]) for i in chosen])
            each = size[words]
            ends = np.cumsum(each)
            slots = flat[np.repeat(first[words] - ends + each, each) + np.arange(ends[-1])]
            lengths = np.array([sum(len(spans[i][1]) for i in chosen[j : j + SWITCHED]) for j in range(0, len(chosen), SWITCHED)])
            scores = np.add.reduceat(weight[slots], ends - each, axis=0)
            post, pair, _ = forward_backward(scores, moved, lengths)
            post[np.arange(len(words)), truth] -= 1
            wrong = np.repeat(post, each, axis=0) / len(lengths)
            for k in range(n_labels):
                slope = np.bincount(slots, wrong[:, k], dim)
                grown[:, k] += slope**2
                weight[:, k] -= RATE * slope / np.sqrt(grown[:, k])
            inner = np.ones(len(words), bool)
            inner[np.cumsum(lengths) - 1] = False
            i = np.flatnonzero(inner)
            seen = np.zeros_like(moved)
            np.add.at(seen, (truth[i], truth[i + 1]), 1)
            slope = (pair - seen) / len(lengths)
            grown_moved += slope**2
            moved -= RATE * slope / np.sqrt(grown_moved)
    return {"labels": labels, "weight": weight.astype(np.float32), "moved": moved, "lexicon": lexicon}


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> dict:
    """Train on a bounded sample of the labelled rows: SAMPLE_DOCS of each language by hash of the key.

    Twice as many are looked up by their hashes, and of these the ones with short enough texts come first.
    Only rows of hashes so small that enough are sure to be below are looked at; should there be
    too few after all, as with keys that repeat, all are.
    """
    rows = labelled.select(F.col(key).alias("row_key"), F.col(label).alias("row_label"), F.col(text).alias("row_text"))
    keys = rows.where("row_label IS NOT NULL").select("row_key", "row_label", F.xxhash64("row_key").alias("h"))
    # Languages are few, so are these counts.
    count = {r.row_label: r.n for r in keys.groupBy("row_label").agg(F.count("*").alias("n")).collect()}
    if not count:
        return train({})
    most = F.create_map(*[F.lit(x) for k, n in sorted(count.items()) for x in (k, min(1.0, 16 * SAMPLE_DOCS / n) * 2.0**64 - 2.0**63)])
    small = keys.where(F.col("h") <= most[F.col("row_label")])
    w = Window.partitionBy("row_label").orderBy("h", "row_key")
    first = lambda df: df.withColumn("n", F.row_number().over(w)).where(F.col("n") <= 2 * SAMPLE_DOCS)
    best = first(small)
    held = {r.row_label: r.n for r in best.groupBy("row_label").agg(F.count("*").alias("n")).collect()}
    if any(held.get(k, 0) < min(n, 2 * SAMPLE_DOCS) for k, n in count.items()):
        best = first(keys)
    found = rows.join(F.broadcast(best.select("row_key", "row_label", "h").distinct()), ["row_key", "row_label"])
    short = Window.partitionBy("row_label").orderBy(F.coalesce(F.length("row_text"), F.lit(0)) > SAMPLE_CHARS, "h", "row_key", F.xxhash64("row_text"))
    found = found.withColumn("n", F.row_number().over(short)).where(F.col("n") <= SAMPLE_DOCS)
    sample: dict[str, list[str]] = {}
    for row in found.select("row_label", "row_text", "n").sort("row_label", "n").collect():
        sample.setdefault(row.row_label, []).append(row.row_text)
    return train(sample)


class Codes(dict):
    """Codes of pieces of text; those that are not known are MISSING."""

    def __missing__(self, piece: str) -> int:
        return MISSING


class Labeller:
    """A trained model with the scores of the words that it remembers.

    Texts are cut at white space, which no word spans; each piece is looked up as
    the place of its word's scores, NONE, or as a number below that for several words.
    """

    def __init__(self, model: dict):
        self.labels, self.weight, self.moved = model["labels"], model["weight"], model["moved"]
        self.features = Features(model["lexicon"])
        self.forget()

    def forget(self) -> None:
        self.known = Codes()
        self.words: dict[str, int] = {}
        self.several: list[list[int]] = []
        self.scores = np.zeros((1024, max(1, len(self.labels))), np.float32)

    def _learn(self, pieces: list[str]) -> None:
        found = [LETTERS.findall(x) for x in pieces]
        fresh = list({w for x in found for w in x if w not in self.words})
        need = len(self.words) + len(fresh)
        if need > len(self.scores):
            grown = np.zeros((max(need, 2 * len(self.scores)), self.scores.shape[1]), np.float32)
            grown[: len(self.scores)] = self.scores
            self.scores = grown
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            grams, start, affixes = self.features.of(part)
            total = np.add.reduceat(self.weight[grams].sum(axis=1), start, axis=0) + self.weight[affixes].sum(axis=1)
            self.scores[len(self.words) : len(self.words) + len(part)] = total
            self.words.update(zip(part, range(len(self.words), len(self.words) + len(part)), strict=True))
        for piece, own in zip(pieces, found, strict=True):
            if len(own) == 1:
                self.known[piece] = self.words[own[0]]
            elif own:
                self.several.append([self.words[w] for w in own])
                self.known[piece] = NONE - len(self.several)
            else:
                self.known[piece] = NONE

    def word_numbers(self, documents: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the scores of all words, text after text, and the words of each text."""
        pieces = [x.lower().split() for x in documents]
        flat = [w for x in pieces for w in x]
        if len(self.known) > REMEMBERED:
            self.forget()
        codes = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        missing = np.flatnonzero(codes == MISSING).tolist()
        if missing:
            self._learn(list({flat[i] for i in missing}))
            codes[missing] = [self.known[flat[i]] for i in missing]
        owner = np.repeat(np.arange(len(documents)), [len(x) for x in pieces])
        several = np.flatnonzero(codes < NONE)
        if len(several):
            size = np.minimum(codes + 1, 1)
            lists = [self.several[NONE - c - 1] for c in codes[several].tolist()]
            size[several] = [len(x) for x in lists]
            size[codes == NONE] = 0
            start = np.cumsum(size) - size
            out = np.repeat(codes, size)
            each = size[several]
            at = np.repeat(start[several] - np.cumsum(each) + each, each) + np.arange(each.sum())
            out[at] = [w for x in lists for w in x]
            return out, np.bincount(np.repeat(owner, size), minlength=len(documents))
        held = codes != NONE
        return codes[held], np.bincount(owner[held], minlength=len(documents))

    def predict(self, documents: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        preds, scores = [UNKNOWN] * len(documents), [0.0] * len(documents)
        if not self.labels:
            return preds, scores
        words, lengths = self.word_numbers(documents)
        if not len(words):
            return preds, scores
        some = np.flatnonzero(lengths)
        share = Lattice(self.scores[words].astype(np.float64), self.moved, lengths).expected()[some]
        best = share.argmax(axis=1)
        score = np.minimum(1.0, share[np.arange(len(some)), best] / lengths[some])
        for i, k, x in zip(some.tolist(), best.tolist(), score.tolist(), strict=True):
            preds[i], scores[i] = self.labels[k], x
        return preds, scores


def identify(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row. The model's size is fixed by its feature buckets."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    ddl = "row_key long, lang_pred string, score double"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, labeller = arrow_schema(ddl), kept(f"crf-{sent._path}", lambda: Labeller(sent.value))
        for batch in it:
            for part in slices(batch, "row_text"):
                preds, scores = labeller.predict(list(texts(part, "row_text")))
                yield batches({"row_key": part.column("row_key"), "lang_pred": preds, "score": scores}, schema)

    return docs.select(F.col(key).cast("long").alias("row_key"), F.col(text).alias("row_text")).mapInArrow(run, ddl).withColumnRenamed("row_key", key)


def accepted(docs: DataFrame, model: dict, least: float, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that have a language whose share is at least this."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = kept(f"crf-{sent._path}", lambda: Labeller(sent.value))
        for batch in it:
            for part in slices(batch, text):
                preds, scores = labeller.predict(list(texts(part, text)))
                yield part.filter(pa.array([p != UNKNOWN and s >= least for p, s in zip(preds, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, ddl)
