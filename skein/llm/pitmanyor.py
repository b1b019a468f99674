"""Language-model scores from a hierarchical Pitman-Yor model of word pairs.

Every word is the context of a restaurant that seats the words that follow it;
all these restaurants share one parent, whose customers are their tables and
whose base is uniform over the known words and one for all others. Gibbs sweeps
draw, for every context and word with several customers, the number of its
tables given all others (see skein.llm.tables), then the seating of the parent. After burn-in, the predictive
probabilities of several sweeps are averaged. Within a sweep all draws use the
totals of the sweep before, so that they can be made in parallel.

How it is distributed. The corpus is written once as chunks of word codes.
A chunk asks each bucket of word pairs, and of words, once for everything it
holds, whatever the number of times it occurs, and gets arrays in the order of
its request. So a key takes one row a chunk at most, and no bucket depends on
how frequent a word or pair is. The number of buckets follows the number of
tokens; each fits a task. The driver sees only totals.

Edge cases: a null text is an empty one, whose only token is the end; rows that
repeat are scored and counted each; a null doc_id is no held-out row; without
training rows the model is its base; texts are read whole, and a task's memory
follows its longest text; other columns are not read.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import arrow_schema, batches, bounded_batches, forget, kept, made, settled, stash, texts
from skein.llm.packed import PARTITION_BITS, by_bucket, chunk_place, narrow, planes, read, unplaned, wide
from skein.llm.tables import draw_tables, log_stirling  # noqa: F401

BURN_IN, SAMPLES = 1, 2
CHUNK_TOKENS = 4_500_000
PAIR_TOKENS, WORD_TOKENS = 3_000_000, 6_000_000
STRENGTH = 1.0
REMEMBERED = 800_000
#: A line end is white space and so no word: it stands for a text's end, and for what precedes its first word.
END = xxhash.xxh64_intdigest(b"\n")
ROW = "kind string, dest int, src long, a binary, b binary, c binary, d binary, e binary"
U8, U4, I8, F8 = np.dtype("<u8"), np.dtype("<u4"), np.dtype("<i8"), np.dtype("<f8")


def row(kind: str, dest: int, src: int, *arrays: np.ndarray) -> dict:
    blobs = [np.ascontiguousarray(x).tobytes() for x in arrays] + [None] * (5 - len(arrays))
    return {"kind": kind, "dest": dest, "src": src} | dict(zip("abcde", blobs, strict=True))


def emit(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(ROW)
    for at in range(0, len(rows), 64):
        yield batches({n: [r[n] for r in rows[at : at + 64]] for n in schema.names}, schema)


def received(it: Iterator[pa.RecordBatch]) -> dict[str, list[tuple]]:
    """The rows of a task by kind: (src, a, b, c, d, e), ordered by src."""
    held: dict[str, list[tuple]] = {}
    for batch in it:
        for kind, src, *blobs in zip(*(batch.column(c).to_pylist() for c in ("kind", "src", *"abcde")), strict=True):
            held.setdefault(kind, []).append((src, *blobs))
    return {k: sorted(v, key=lambda x: x[0]) for k, v in held.items()}


# --- the corpus as codes -----------------------------------------------------

CHUNK = "chunk long, n long, ids binary, lengths binary, held binary, words binary, codes binary"


def code_corpus(docs: DataFrame) -> DataFrame:
    """Chunks of documents: sorted hashes of their words, the documents as codes of these, and their ids beside a mark for those that aren't null."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, (known, prints) = arrow_schema(CHUNK), kept("pitman-yor-words", lambda: ({b"\n": 0}, [END]))
        chunk, size, parts = TaskContext.get().partitionId() << PARTITION_BITS, 0, []

        def done() -> pa.RecordBatch:
            """The chunk, with numbers of the worker's words turned into codes of its own."""
            flat, hashes = np.concatenate([x for _, _, x in parts]), np.array(prints, np.uint64)
            used = np.flatnonzero(np.bincount(flat, minlength=len(prints)))
            used = used[np.argsort(hashes[used])]
            code = np.zeros(len(prints), np.uint32)
            code[used] = np.arange(len(used))
            ids = np.array([[i or 0 for i, _, _ in parts], [i is not None for i, _, _ in parts]], I8)
            out = [ids, np.array([len(x) for _, _, x in parts], U4), np.array([h for _, h, _ in parts], np.uint8), planes(hashes[used]), narrow(code[flat])]
            return batches({"chunk": [chunk], "n": [size]} | {k: [np.ascontiguousarray(v).tobytes()] for k, v in zip(schema.names[2:], out, strict=True)}, schema)

        for batch in it:
            for doc, held, x in zip(batch.column("doc").to_pylist(), batch.column("held").to_pylist(), texts(batch, "row_text"), strict=True):
                words = x.encode().lower().split()
                words.append(b"\n")
                try:
                    found = np.fromiter((known[w] for w in words), np.int32, len(words))
                except KeyError:
                    for w in words:
                        if w not in known:
                            known[w] = len(prints)
                            prints.append(xxhash.xxh64_intdigest(w))
                    found = np.fromiter((known[w] for w in words), np.int32, len(words))
                parts.append((doc, held, found))
                size += len(words)
                if size >= CHUNK_TOKENS or len(prints) > REMEMBERED:
                    yield done()
                    chunk, size, parts = chunk + 1, 0, []
                    if len(prints) > REMEMBERED:
                        known.clear()
                        known[b"\n"] = 0
                        del prints[1:]
        if parts:
            yield done()

    return docs.mapInArrow(run, CHUNK)


class Chunk:
    """A chunk's words and distinct pairs, in the order in which it asks for them."""

    def __init__(self, lengths: bytes, held: bytes, words: bytes, codes: bytes):
        self.lengths, self.held = read(lengths, U4).astype(np.int64), read(held, np.dtype(np.uint8)).astype(bool)
        self.words, self.codes = unplaned(words), wide(codes).astype(U4)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def train(self) -> np.ndarray:
        """Whether each token is in training."""
        return np.repeat(~self.held, self.lengths)

    def word_bucket(self, buckets: int) -> np.ndarray:
        return bucket_of(self.words, buckets)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs as context code times words plus word code, in order; and each token's place among them."""
        end = int(np.searchsorted(self.words, np.uint64(END)))
        both = np.empty(len(self.codes), np.int64)
        both[1:] = self.codes[:-1]
        both[self.starts] = end
        both *= len(self.words)
        both += self.codes
        return ranked(both, len(self.words) ** 2)

    def pair_counts(self, pairs: int, places: np.ndarray) -> np.ndarray:
        """How often each distinct pair occurs in training."""
        return np.bincount(places[self.train()], minlength=pairs)

    def pair_bucket(self, u: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
        return bucket_of(self.words[u] * np.uint64(0x9E3779B97F4A7C15) ^ self.words[w], buckets)


def ranked(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (from 0 to most) in order, and the place of each key among them."""
    bits = len(keys).bit_length()
    if most.bit_length() + bits < 64:  # one sort of keys with their places behind is the fastest
        keys <<= bits
        keys |= np.arange(len(keys))
        keys.sort()
        at = (keys & ((1 << bits) - 1)).astype(np.uint32)
        keys >>= bits
    else:
        at = np.argsort(keys)
        keys = keys[at]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    places = np.empty(len(keys), np.uint32)
    places[at] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return keys[new], places


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (hashes ^ hashes >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def chunks_of(batch: pa.RecordBatch) -> Iterator[tuple[int, Chunk]]:
    for chunk, *blobs in zip(*(batch.column(c).to_pylist() for c in ("chunk", "lengths", "held", "words", "codes")), strict=True):
        yield chunk, Chunk(*blobs)


def ask_words(chunks: DataFrame, buckets: int) -> DataFrame:
    """Every chunk's words and their training counts, to the words' buckets."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for number, chunk in chunks_of(batch):
                n = np.bincount(chunk.codes[chunk.train()], minlength=len(chunk.words))
                yield from emit([row("ask", k, number, planes(chunk.words[at]), narrow(n[at])) for k, at in enumerate(by_bucket(chunk.word_bucket(buckets), buckets)) if len(at)])

    return chunks.select("chunk", "lengths", "held", "words", "codes").mapInArrow(run, ROW)


def ask_pairs(chunks: DataFrame, buckets: int) -> DataFrame:
    """Every chunk's distinct pairs and their training counts, to the pairs' buckets."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for number, chunk in chunks_of(batch):
                distinct, places = chunk.pairs()
                n = chunk.pair_counts(len(distinct), places)
                u, w = np.divmod(distinct, len(chunk.words))
                del distinct, places
                out = []
                for k, at in enumerate(by_bucket(chunk.pair_bucket(u, w, buckets), buckets)):
                    if len(at):
                        used, place = np.unique(np.concatenate([u[at], w[at]]), return_inverse=True)
                        first = np.flatnonzero(np.diff(u[at], prepend=-1))  # pairs of a context stand together
                        out.append(row("ask", k, number, planes(chunk.words[used]), narrow(place[first]), narrow(np.diff(first, append=len(at))), narrow(place[len(at) :]), narrow(n[at])))
                yield from emit(out)

    return chunks.select("chunk", "lengths", "held", "words", "codes").mapInArrow(run, ROW)


# --- the buckets of pairs ----------------------------------------------------


def sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, and each value summed by key."""
    distinct, where = np.unique(keys, return_inverse=True)
    return distinct, *(np.bincount(where, v, len(distinct)).astype(np.int64) for v in values)


def to_words(kind: str, src: int, buckets: int, keys: np.ndarray, *values: np.ndarray) -> list[dict]:
    return [row(kind, k, src, planes(keys[at]), *(narrow(v[at]) for v in values)) for k, at in enumerate(by_bucket(bucket_of(keys, buckets), buckets)) if len(at)]


def build(asked: DataFrame, buckets: int, word_buckets: int) -> DataFrame:
    """Add up the chunks' counts of pairs. Of each bucket: state rows (pairs with several customers),
    code rows (what each chunk asked for: 0 unseen, 1 once, 2+k the k-th state pair), single rows
    (pairs with one customer, summed by context and by word, for the words' buckets) and totals."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("pitman-yor", dict)
        own, rows = TaskContext.get().partitionId(), received(it).get("ask", [])
        if not rows:
            return
        u, w, n, size = [], [], [], []
        for i, (_, names, heads, runs, places, counts) in enumerate(rows):
            names = unplaned(names)
            u.append(names[np.repeat(wide(heads), wide(runs))])
            w.append(names[wide(places)])
            n.append(wide(counts))
            size.append(len(n[-1]))
            rows[i] = rows[i][:1]
        u, w, n = np.concatenate(u), np.concatenate(w), np.concatenate(n)
        order = np.lexsort((w, u))
        new = np.concatenate([[True], (np.diff(u[order]) != 0) | (np.diff(w[order]) != 0)])
        of_row = np.empty(len(order), np.int64)
        of_row[order] = np.cumsum(new) - 1
        count = np.add.reduceat(n[order], np.flatnonzero(new))
        u, w = u[order][new], w[order][new]
        many = count >= 2
        code = np.minimum(count, 1)
        code[many] = 2 + np.arange(many.sum())
        out = [row("code", own, r[0], narrow(x)) for r, x in zip(rows, np.split(code[of_row], np.cumsum(size)[:-1]), strict=True)]
        keys, where = np.unique(np.concatenate([u[many], w[many]]), return_inverse=True)
        out.append(row("state", own, 0, planes(keys), narrow(where), narrow(count[many]), narrow(np.ones(many.sum(), U4))))
        once = count == 1
        names = np.concatenate([u[once], w[once]])
        side = np.repeat([True, False], once.sum())
        out += to_words("single", own, word_buckets, *sums(names, side, ~side))
        out.append(row("total", 0, own, np.array([once.sum(), (count == 2).sum()], I8)))
        yield from emit(out)

    return asked.repartitionById(buckets, "dest").mapInArrow(run, ROW)


def sweep(state: DataFrame, replies: DataFrame | None, model: dict, buckets: int, word_buckets: int, turn: int) -> DataFrame:
    """Draw the tables of all state pairs; state rows with the draw added, and sums for the words' buckets."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = TaskContext.get().partitionId(), received(it)
        for _, keys, where, count, tables, _ in rows.get("state", []):
            keys, where, count = unplaned(keys), wide(where), wide(count)
            n = len(count)
            drawn = wide(tables).reshape(-1, n) if n else np.zeros((1, 0), np.int64)
            if turn and n:
                seats, prob = np.zeros(len(keys), np.int64), np.zeros(len(keys))
                for k, at in enumerate(by_bucket(bucket_of(keys, word_buckets), word_buckets)):
                    for _, t, p, *_ in (r for r in rows["reply"] if r[0] == k):
                        seats[at], prob[at] = read(t, I8), read(p, F8)
                others = np.maximum(seats[where[:n]] - drawn[-1], 0)
                now = draw_tables(count, others, prob[where[n:]], model["d1"], STRENGTH, np.random.default_rng([turn, own]))
                drawn = np.concatenate([drawn[1:] if len(drawn) >= SAMPLES else drawn, now[None]]) if turn > BURN_IN + 1 else now[None]
            out = [row("state", own, 0, planes(keys), narrow(where), narrow(count), narrow(drawn.ravel()))]
            if n:
                both = np.concatenate([np.bincount(where[i * n : i * n + n], t, len(keys)) for t in drawn for i in (0, 1)]).reshape(-1, len(keys)).astype(I8)
                for k, at in enumerate(by_bucket(bucket_of(keys, word_buckets), word_buckets)):
                    if len(at):
                        out.append(row("multi", k, own, planes(keys[at]), narrow(both[:, at].ravel())))
            yield from emit(out)

    rows = state if replies is None else state.unionByName(replies)
    return rows.repartitionById(buckets, "dest").mapInArrow(run, ROW)


# --- the buckets of words ----------------------------------------------------


def word_table(asked: DataFrame, singles: DataFrame, word_buckets: int) -> DataFrame:
    """Known words with count, and tables of pairs with one customer, as context and as word; and totals."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = TaskContext.get().partitionId(), received(it)
        asks, single = rows.get("ask", []), rows.get("single", [])
        if not asks:
            return
        keys, count = sums(np.concatenate([unplaned(r[1]) for r in asks]), np.concatenate([wide(r[2]) for r in asks]))
        keys, count = keys[count > 0], count[count > 0]
        as_u, as_w = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for r in single:
            at = np.searchsorted(keys, unplaned(r[1]))
            as_u[at] += wide(r[2])
            as_w[at] += wide(r[3])
        yield from emit([row("word", own, 0, keys, count.astype(I8), as_u, as_w), row("total", 0, own, np.array([len(keys), count.sum()], I8))])

    return asked.unionByName(singles).repartitionById(word_buckets, "dest").mapInArrow(run, ROW)


def root_tables(rows: dict[str, list[tuple]], model: dict, turn: int, own: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Keys and counts of a bucket's words, and of each draw their tables as context, customers at the root, and root tables."""
    word = rows.get("word") or [(0, b"", b"", b"", b"", None)]
    keys, count, as_u, as_w = read(word[0][1], U8), read(word[0][2], I8), read(word[0][3], I8), read(word[0][4], I8)
    draws: list[list[np.ndarray]] = []
    for r in rows.get("multi", []):
        names = unplaned(r[1])
        values, at = wide(r[2]).reshape(-1, len(names)), np.searchsorted(keys, names)
        while len(draws) < len(values) // 2:
            draws.append([as_u.copy(), as_w.copy()])
        for i, v in enumerate(values):
            draws[i // 2][i % 2][at] += v
    out = []
    for i, (tables, customers) in enumerate(draws or [[as_u, as_w]]):
        rng = np.random.default_rng([turn, i, own, 7])
        base = np.full(len(keys), 1.0 / (model["words"] + 1))
        at_root = draw_tables(customers, np.full(len(keys), max(0, model["root_tables"] - 1)), base, model["d0"], STRENGTH, rng)
        out.append((tables, customers, at_root))
    return keys, count, out


def answer_sweep(words: DataFrame, multi: DataFrame, model: dict, word_buckets: int, turn: int) -> DataFrame:
    """Root seating after a sweep; to the pairs' buckets, tables and root customers and tables of their keys; and totals."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = TaskContext.get().partitionId(), received(it)
        keys, _, draws = root_tables(rows, model, turn, own)
        if not len(keys):
            return
        tables, customers, at_root = draws[-1]
        out = [row("total", 0, own, np.array([customers.sum(), at_root.sum(), (customers == 1).sum(), (customers == 2).sum()], I8))]
        for r in rows.get("multi", []):
            at = np.searchsorted(keys, unplaned(r[1]))
            out.append(row("seats", r[0], own, narrow(tables[at]), narrow(customers[at]), narrow(at_root[at])))
        yield from emit(out)

    return words.unionByName(multi).repartitionById(word_buckets, "dest").mapInArrow(run, ROW)


def root_probability(customers: np.ndarray, tables: np.ndarray, model: dict) -> np.ndarray:
    fresh_mass = (STRENGTH + model["d0"] * model["root_tables"]) / (model["words"] + 1)
    return (customers - model["d0"] * tables + fresh_mass) / (STRENGTH + model["root_customers"])


def priced(seats: DataFrame, model: dict) -> DataFrame:
    """Replies for the pairs' buckets: tables as context, and the root's probability."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for dest, src, a, b, c in zip(*(batch.column(x).to_pylist() for x in ("dest", "src", "a", "b", "c")), strict=True):
                out.append(row("reply", dest, src, wide(a), root_probability(wide(b), wide(c), model)))
            yield from emit(out)

    return seats.mapInArrow(run, ROW)


def answer_chunks(words: DataFrame, multi: DataFrame, asked: DataFrame, word_buckets: int, model: dict, turn: int) -> DataFrame:
    """To every chunk, for the words it asked for: count, and of each draw the tables as context, root customers and root tables."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = TaskContext.get().partitionId(), received(it)
        keys, count, draws = root_tables(rows, model, turn, own)
        totals = np.array([[c.sum(), t.sum()] for _, c, t in draws], I8)
        yield from emit([row("total", 0, own, totals)])
        held = np.stack([count, *[x for d in draws for x in d]])
        for src, names, *_ in rows.get("ask", []):
            names = unplaned(names)
            at = np.minimum(np.searchsorted(keys, names), max(0, len(keys) - 1))
            found = held[:, at] * (keys[at] == names) if len(keys) else np.zeros((len(held), len(names)), np.int64)
            yield from emit([row("words", own, src, narrow(found.ravel()))])

    return words.unionByName(multi).unionByName(asked).repartitionById(word_buckets, "dest").mapInArrow(run, ROW)


def answer_pairs(state: DataFrame, codes: DataFrame, buckets: int) -> DataFrame:
    """To every chunk, for the pairs it asked for: customers, and tables of each draw."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = TaskContext.get().partitionId(), received(it)
        for _, _, _, count, tables, _ in rows.get("state", []):
            count = wide(count)
            drawn = wide(tables).reshape(-1, len(count)) if len(count) else np.zeros((1, 0), np.int64)
            once = np.array([[0, 1]] * (1 + len(drawn)), U4)
            held = np.concatenate([once, np.concatenate([count[None], drawn])], axis=1)
            for src, code, *_ in rows.get("code", []):
                yield from emit([row("pairs", own, src, narrow(held[:, wide(code)].ravel()))])

    return state.unionByName(codes).repartitionById(buckets, "dest").mapInArrow(run, ROW)


# --- scores ------------------------------------------------------------------


def score_chunk(chunk: Chunk, words: dict[int, bytes], pairs: dict[int, bytes], model: dict, buckets: int, word_buckets: int) -> dict[str, np.ndarray]:
    """Of each document of a chunk: tokens, known tokens and both scores."""
    found = aligned(words, chunk.word_bucket(word_buckets), word_buckets)
    distinct, places = chunk.pairs()
    u, w = np.divmod(distinct, len(chunk.words))
    seen = aligned(pairs, chunk.pair_bucket(u, w, buckets), buckets)
    count, prob = found[0], np.zeros(len(distinct))
    draws = len(model["roots"])
    for s, (customers, tables) in enumerate(model["roots"]):
        base = root_probability(found[2 + 3 * s], found[3 + 3 * s], model | {"root_customers": customers, "root_tables": tables})
        top = np.maximum(seen[0] - model["d1"] * seen[min(1 + s, len(seen) - 1)], 0) + (STRENGTH + model["d1"] * found[1 + 3 * s][u]) * base[w]
        prob += np.where(count[u] > 0, top / (STRENGTH + count[u]), base[w]) / draws
    del seen, u, w, distinct
    per_token = np.log10(prob)[places]
    flat = np.log10((count + 1.0) / (model["tokens"] + model["words"] + 1))
    add = lambda x: np.add.reduceat(x, chunk.starts)  # noqa: E731  every document has a token
    return {"n_tokens": chunk.lengths, "n_known": add((count > 0)[chunk.codes].astype(np.int64)), "base_score": add(flat[chunk.codes]), "score": add(per_token)}


def aligned(replies: dict[int, bytes], bucket: np.ndarray, buckets: int) -> np.ndarray:
    """The buckets' replies in the order of what was asked for, one row for each value."""
    out: np.ndarray | None = None
    for k, at in enumerate(by_bucket(bucket, buckets)):
        if len(at):
            values = wide(replies.pop(k)).reshape(-1, len(at))
            out = np.zeros((len(values), len(bucket)), np.int32) if out is None else out
            out[:, at] = values
    return out


def score(chunks: DataFrame, words: DataFrame, pairs: DataFrame, model: dict, buckets: int, word_buckets: int, most: int, tasks: int) -> DataFrame:
    """Bring each chunk and the replies to it together, and score its documents; most: the chunks of a partition at most."""
    own = chunks.select(F.lit("chunk").alias("kind"), F.lit(0).alias("dest"), F.col("chunk").alias("src"), F.col("lengths").alias("a"), F.col("held").alias("b"), F.col("words").alias("c"), F.col("codes").alias("d"), F.col("ids").alias("e"))
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("pitman-yor", dict)
        schema, now, held = arrow_schema(ddl), None, {"words": {}, "pairs": {}, "chunk": {}}

        def done() -> Iterator[pa.RecordBatch]:
            lengths, flags, names, codes, ids = held["chunk"].pop(0)
            found = score_chunk(Chunk(lengths, flags, names, codes), held["words"], held["pairs"], model, buckets, word_buckets)
            ids, present = read(ids, I8).reshape(2, -1)
            found |= {"doc_id": pa.array(ids, pa.int64(), mask=present == 0), "held_out": read(flags, np.dtype(np.uint8)).astype(bool)}
            yield batches(found, schema)

        for batch in it:
            for kind, dest, src, *blobs in zip(*(batch.column(c).to_pylist() for c in ("kind", "dest", "src", *"abcde")), strict=True):
                if src != now and now is not None:
                    yield from done()
                    held = {"words": {}, "pairs": {}, "chunk": {}}
                now = src
                held[kind][dest] = blobs if kind == "chunk" else blobs[0]
        if now is not None:
            yield from done()

    rows = own.unionByName(words).unionByName(pairs)
    return rows.repartitionById(tasks, chunk_place("src", most, tasks)).sortWithinPartitions("src").mapInArrow(run, ddl)


def totals(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of the total rows: one small row came from each bucket."""
    found = [read(r.a, I8) for r in rows.where("kind = 'total'").select("a").collect()]
    return np.sum(found, axis=0) if found else np.zeros(width, np.int64)


def tidy(spark) -> None:
    """Let Spark delete the shuffle files of finished steps."""
    gc.collect()
    spark._jvm.System.gc()


def discount(once: int, twice: int) -> float:
    """The usual estimate from the numbers of types seen once and twice, kept inside (0, 1)."""
    return float(np.clip(once / max(1, once + 2 * twice), 0.1, 0.95))


def score_documents(docs: DataFrame, held_out, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row,
    from a model of the rows where held_out (a column) is false."""
    spark = docs.sparkSession
    bounded_batches(spark)
    before = len(made(spark))
    rows = docs.select(F.col(key).cast("long").alias("doc"), held_out.alias("held"), F.col(text).alias("row_text"))
    chunks = stash(code_corpus(rows), "chunks")
    size = chunks.agg(F.sum("n").alias("tokens"), F.count("*").alias("chunks"), F.max(F.col("chunk").bitwiseAND((1 << PARTITION_BITS) - 1)).alias("last"), F.max(F.shiftright("chunk", PARTITION_BITS)).alias("partition")).first()
    tokens, most = size.tokens or 0, 1 + (size.last or 0)
    buckets, word_buckets = max(12, -(-tokens // PAIR_TOKENS)), max(8, -(-tokens // WORD_TOKENS))
    built = stash(build(ask_pairs(chunks, buckets), buckets, word_buckets), "pairs", by="kind")
    of = lambda df, kind: df.where(F.col("kind") == kind)
    tidy(spark)  # the shuffle of pairs is the largest
    once, twice = totals(built, 2).tolist()
    asked = ask_words(chunks, word_buckets)
    words = stash(word_table(asked, of(built, "single"), word_buckets), "words", by="kind")
    n_words, n_tokens = totals(words, 2).tolist()
    model = {"d1": discount(once, twice), "d0": 0.5, "words": n_words, "tokens": n_tokens, "root_tables": n_words, "root_customers": 0}
    state, replies, table = of(built, "state"), None, of(words, "word")
    past: list[DataFrame] = []
    for turn in range(BURN_IN + SAMPLES + 1):
        moved = stash(sweep(state, replies, model, buckets, word_buckets, turn), "sweep", by="kind")
        if turn < BURN_IN + SAMPLES:
            seats = stash(answer_sweep(table, of(moved, "multi"), model, word_buckets, turn), "seats", by="kind")
            customers, at_root, singles, doubles = totals(seats, 4).tolist()
            model = model | {"d0": discount(singles, doubles), "root_tables": at_root, "root_customers": customers}
            replies = priced(of(seats, "seats"), model)
        forget(*past)
        past, state = [moved, *([seats] if turn < BURN_IN + SAMPLES else [])], of(moved, "state")
        tidy(spark)
    to_chunks = stash(answer_chunks(table, of(moved, "multi"), asked, word_buckets, model, turn), "word-replies", by="kind")
    model = model | {"roots": totals(to_chunks, 2).reshape(-1, 2).tolist()}
    pairs = stash(answer_pairs(state, of(built, "code"), buckets), "pair-replies")
    forget(built, words, *past)
    tidy(spark)
    scored = score(chunks, of(to_chunks, "words"), pairs, model, buckets, word_buckets, most, max(8, min(2 * size.chunks, most * (1 + (size.partition or 0)))))
    scored = scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
    return settled(scored, "scores", before)
