"""Substring dedup by sliding sentence spans.

A text is a sequence of sentences, cut after . ! ? | their wide forms and line
ends; a sentence of WINDOW words or more is cut further, after the word of the least
hash of every WINDOW words in a row. So equal passages are cut alike in any host but for
WINDOW words at each end. A span is any run of SENTENCES or more whole sentences, and any run
of parts that has LONG_WORDS words or more. Of equal spans of all documents the first by
(doc_id, position) stays, and the parts that any other covers are removed.

It is enough to hash the shortest spans: from each part on and up to each part the
shortest run of LONG_WORDS words, and each SENTENCES sentences of fewer words. They cover every
longer span, and where that repeats, they do, at the same places of it.

How it is distributed. Documents are read in chunks. A chunk knows which of its spans
repeat within it, and asks the buckets that hashes are dealt to once for each hash, with
its first place. A bucket answers with one bit for each hash asked for, which tells whether
an earlier place is elsewhere. So a passage that a third of all documents share takes one entry
of a chunk, like any other. What goes is gathered by document and meets its text in a join.

Edge cases: null and empty texts have no spans and stay as they are; rows that
repeat a doc_id with the same text count as one document and share its fate,
with another text they are told apart by it; a null doc_id sorts first; a text
of which everything is removed becomes empty; texts are read whole; other
columns pass through unchanged, and where one has the name of a count, the count's
gets an underscore behind it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import arrow_schema, batches, bounded_batches, free_names, kept, made, settled, stash
from skein.llm.packed import by_bucket, chunk_place, narrow, planes, read, unplaned, wide

SENTENCES = 3
#: Words that are a span whatever sentences they are of.
LONG_WORDS = 16
#: Words in a row of which one ends a part.
WINDOW = 12
MARKS = ".!?|。！？…"
SENTENCE = re.compile(rf"[^{MARKS}\n]*(?:[{MARKS}\n]+[^\S\n]*|$)")
#: White space as bytes.split sees it, so that words are counted alike.
WORDS = re.compile(r"[^ \t\n\r\f\v]+[ \t\n\r\f\v]*")
#: Spans of a chunk and of a bucket, about.
CHUNK_SPANS, BUCKET_SPANS = 1_000_000, 2_000_000
#: An odd number and its inverse modulo 2**64: hashes of runs are differences of sums.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = "chunk long, n long, docs binary, versions binary, hashes binary, first binary, rank binary, each binary, at binary, parts binary"
ROW = "kind string, dest int, src long, a binary, b binary, c binary, d binary, e binary"
GONE = "skein_doc long, skein_version long, skein_spans binary"


def pieces(sentence: str) -> list[str]:
    """A sentence cut after the word of the least hash of every WINDOW words in a row; shorter ones stay whole."""
    if len(sentence) < 2 * WINDOW - 1:
        return [sentence]
    rank = list(map(zlib.crc32, sentence.lower().encode("utf-8", "surrogatepass").split()))
    n, cuts, least = len(rank), [], -1
    for stop in range(WINDOW, n + 1):
        if least < stop - WINDOW:  # it has left the window
            least = min(range(stop - WINDOW, stop), key=lambda i: (rank[i], -i))
            cuts.append(least)
        elif rank[stop - 1] <= rank[least]:
            least = stop - 1
            cuts.append(least)
    if not cuts:
        return [sentence]
    ends = [m.end() for m in WORDS.finditer(sentence)]
    at = [0, *[ends[i] for i in cuts if i < n - 1], len(sentence)]
    return [sentence[x:y] for x, y in zip(at, at[1:], strict=False)]


def sentences(text: str) -> list[str]:
    """The parts of a text, sentences or pieces of long ones, which join to the whole text."""
    return [y for x in SENTENCE.findall(text) if x for y in pieces(x)]


class Parts:
    """The parts with words of texts, one text after another. Others, such as empty lines, neither count nor break a run."""

    def __init__(self):
        self.hash: list[int] = []
        self.words: list[int] = []
        self.ends: list[bool] = []
        self.place: list[int] = []

    def add(self, text: str) -> None:
        place, before = 0, len(self.hash)
        for sentence in SENTENCE.findall(text):
            if sentence:
                own = pieces(sentence)
                for part in own:
                    shown = part.lower().split()
                    if shown:
                        self.hash.append(xxhash.xxh3_64_intdigest(" ".join(shown)))
                        self.words.append(len(shown))
                        self.ends.append(False)
                        self.place.append(place)
                    place += 1
                if len(self.hash) > before:
                    self.ends[-1] = True


def runs(words: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last part of the shortest spans, in order. owner: the number of each part's text, in order."""
    n = len(words)
    total = np.concatenate(([0], np.cumsum(words)))
    at = np.arange(n)
    last = np.searchsorted(total, total[:-1] + LONG_WORDS) - 1
    first = np.searchsorted(total, total[1:] - LONG_WORDS, side="right") - 1
    on = np.flatnonzero((last < n) & (owner[np.minimum(last, n - 1)] == owner))
    back = np.flatnonzero((first >= 0) & (owner[np.maximum(first, 0)] == owner))
    start = np.flatnonzero(np.concatenate(([True], ends[:-1] | (owner[1:] != owner[:-1]))))
    stop = np.append(start[1:], n) - 1
    a, b = start[: len(start) - SENTENCES + 1], stop[SENTENCES - 1 :]
    few = (owner[a] == owner[b]) & (total[b + 1] - total[a] < LONG_WORDS)
    both = np.concatenate((at[on] * n + last[on], first[back] * n + at[back], a[few] * n + b[few]))
    both.sort()
    both = both[np.diff(both, prepend=-1) != 0]
    return both // max(n, 1), both % max(n, 1)


def run_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of runs of parts: polynomials of the parts' hashes, wherever they stand."""
    n = len(hashes)
    power = lambda base: np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power(INVERSE)[:n], dtype=np.uint64)))
    out = (sums[last + 1] - sums[first]) * power(BASE)[first]
    out ^= out >> np.uint64(29)
    return out * np.uint64(BASE)


class Chunk:
    """Distinct documents (null or not, doc_id, version), in order, with their spans."""

    def __init__(self, docs: dict[tuple[bool, int, int], Parts]):
        order = sorted(docs)
        self.docs = np.array([x[:2] for x in order], np.int64).reshape(-1, 2)
        self.versions = np.array([x[2] for x in order], np.int64)
        held = [docs[x] for x in order]
        each = np.array([len(x.hash) for x in held])
        owner = np.repeat(np.arange(len(held)), each)
        join = lambda name, kind: np.fromiter((v for x in held for v in getattr(x, name)), kind, len(owner))
        place = join("place", np.int64)
        first, last = runs(join("words", np.int64), join("ends", bool), owner)
        hashes = run_hashes(join("hash", np.uint64), first, last)
        by_hash = np.argsort(hashes, kind="stable")
        new = np.diff(hashes[by_hash], prepend=~hashes[by_hash][:1]) != 0
        self.hashes, self.first = hashes[by_hash][new], by_hash[new]
        self.rank = np.empty(len(hashes), np.int64)
        self.rank[by_hash] = np.cumsum(new) - 1
        self.each = np.bincount(owner[first], minlength=len(held))
        self.at, self.parts = place[first], place[last] - place[first] + 1

    def row(self, number: int) -> dict:
        blobs = (self.docs.T, self.versions, planes(self.hashes), *map(narrow, (self.first, self.rank, self.each, self.at, self.parts)))
        return {"chunk": [number], "n": [len(self.at)]} | {k: [np.ascontiguousarray(x).tobytes()] for k, x in zip(("docs", "versions", "hashes", "first", "rank", "each", "at", "parts"), blobs, strict=True)}


def code_spans(docs: DataFrame) -> DataFrame:
    """Chunks of the spans of all documents; a document's version is a hash of its text."""
    bounded_batches(docs.sparkSession, 4 << 20)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, number, held, size = arrow_schema(CHUNK), TaskContext.get().partitionId() << 24, {}, 0
        kept("spans", dict)
        for batch in it:
            for doc, version, x in zip(batch.column("doc").to_pylist(), batch.column("version").to_pylist(), batch.column("row_text"), strict=True):
                key = (doc is not None, doc or 0, version)
                if key not in held:
                    held[key] = own = Parts()
                    own.add(x.as_py() or "")
                    size += len(own.hash)
                if size >= CHUNK_SPANS * 3 // 4:  # a part starts or ends one span, and some two
                    yield batches(Chunk(held).row(number), schema)
                    number, held, size = number + 1, {}, 0
        if held:
            yield batches(Chunk(held).row(number), schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("version"), F.col("text").alias("row_text")).mapInArrow(run, CHUNK)


def spread(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(24)).astype(np.int64) % buckets


def ask(chunks: DataFrame, buckets: int) -> DataFrame:
    """To the buckets of its hashes, each chunk's first place of each: row of its documents there, and part."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ROW)
        for batch in it:
            for number, docs, versions, hashes, first, each, at in zip(*(batch.column(c).to_pylist() for c in ("chunk", "docs", "versions", "hashes", "first", "each", "at")), strict=True):
                docs, versions, hashes, first = read(docs, "<i8").reshape(2, -1), read(versions, "<i8"), unplaned(hashes), wide(first)
                owner, at = np.repeat(np.arange(len(versions)), wide(each))[first], wide(at)[first]
                for k, own in enumerate(by_bucket(spread(hashes, buckets), buckets)):
                    if len(own):
                        used = np.flatnonzero(np.bincount(owner[own], minlength=len(versions)))
                        place = np.searchsorted(used, owner[own])
                        blobs = planes(hashes[own]), narrow(place), narrow(at[own]), docs[:, used], versions[used]
                        yield batches({"kind": ["ask"], "dest": [k], "src": [number]} | {c: [np.ascontiguousarray(x).tobytes()] for c, x in zip("abcde", blobs, strict=True)}, schema)

    return chunks.select("chunk", "docs", "versions", "hashes", "first", "each", "at").mapInArrow(run, ROW)


def later(hashes: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """Whether another entry of the same hash has an earlier place; places are compared one array after another."""
    order = np.argsort(hashes)
    same = np.flatnonzero(hashes[order][1:] == hashes[order][:-1])
    repeated = np.zeros(len(hashes), bool)
    repeated[order[same]] = repeated[order[same + 1]] = True
    at = np.flatnonzero(repeated)
    at = at[np.lexsort((*(x[at] for x in reversed(places)), hashes[at]))]
    head = np.flatnonzero(np.diff(hashes[at], prepend=~hashes[at][:1]) != 0)
    first = at[np.repeat(head, np.diff(head, append=len(at)))] if len(at) else at
    out = np.zeros(len(hashes), bool)
    out[at] = np.logical_or.reduce([x[at] != x[first] for x in places])
    return out


def answer(asked: DataFrame, buckets: int) -> DataFrame:
    """To each chunk that asked a bucket: a bit for each hash, set where an earlier place is elsewhere."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows = arrow_schema(ROW), []
        kept("spans", dict)
        for batch in it:
            for src, *blobs in zip(*(batch.column(c).to_pylist() for c in ("src", *"abcde")), strict=True):
                place, docs = wide(blobs[1]), read(blobs[3], "<i8").reshape(2, -1)
                rows.append((src, unplaned(blobs[0]), docs[0][place].astype(bool), docs[1][place], read(blobs[4], "<i8")[place], wide(blobs[2]).astype(np.int32)))
        if not rows:
            return
        own, sources, sizes = TaskContext.get().partitionId(), [r[0] for r in rows], [len(r[1]) for r in rows]
        hashes, *places = (np.concatenate([r[i] for r in rows]) for i in range(1, 6))
        del rows
        for src, bits in zip(sources, np.split(later(hashes, places), np.cumsum(sizes)[:-1]), strict=True):
            if bits.any():
                yield batches({"kind": ["reply"], "dest": [own], "src": [src], "a": [np.packbits(bits).tobytes()]} | {c: [None] for c in "bcde"}, schema)

    return asked.repartitionById(buckets, "dest").mapInArrow(run, ROW)


def covered(chunks: DataFrame, replies: DataFrame, buckets: int, most: int, tasks: int) -> DataFrame:
    """Of each document that loses something the parts of its spans that go: pairs of first part and number."""
    own = chunks.select(F.lit("chunk").alias("kind"), F.lit(0).alias("dest"), F.col("chunk").alias("src"), "docs", "versions", "hashes", "first", "rank", "each", "at", "parts")
    rest = {c: F.lit(None).cast("binary").alias(c) for c in ("versions", "hashes", "first", "rank", "each", "at", "parts")}
    rows = own.unionByName(replies.select("kind", "dest", "src", F.col("a").alias("docs"), *rest.values()))

    def gone(blobs: list[bytes], bits: dict[int, bytes]) -> pa.RecordBatch:
        docs, versions, hashes = read(blobs[0], "<i8").reshape(2, -1), read(blobs[1], "<i8"), unplaned(blobs[2])
        first, rank, each, at, parts = map(wide, blobs[3:])
        flag = np.zeros(len(hashes), bool)
        for k, own in enumerate(by_bucket(spread(hashes, buckets), buckets)):
            if k in bits:
                flag[own] = np.unpackbits(np.frombuffer(bits[k], np.uint8), count=len(own)).astype(bool)
        hit = np.flatnonzero(flag[rank] | (first[rank] != np.arange(len(rank))))
        owner = np.repeat(np.arange(len(each)), each)[hit]
        pair = np.stack([at[hit], parts[hit]], axis=1).astype("<i4")
        who, start = np.unique(owner, return_index=True)
        spans = [x.tobytes() for x in np.split(pair, start[1:])] if len(who) else []
        return batches({"skein_doc": pa.array(docs[1][who], mask=docs[0][who] == 0), "skein_version": versions[who], "skein_spans": spans}, arrow_schema(GONE))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, bits = None, None, {}
        kept("spans", dict)
        names = ("docs", "versions", "hashes", "first", "rank", "each", "at", "parts")
        for batch in it:
            for kind, dest, src, *own in zip(*(batch.column(c).to_pylist() for c in ("kind", "dest", "src", *names)), strict=True):
                if src != now and blobs is not None:
                    yield gone(blobs, bits)
                    blobs, bits = None, {}
                now = src
                if kind == "chunk":
                    blobs = own
                else:
                    bits[dest] = own[0]
        if blobs is not None:
            yield gone(blobs, bits)

    return rows.repartitionById(tasks, chunk_place("src", most, tasks)).sortWithinPartitions("src").mapInArrow(run, GONE)


def repeats(docs: DataFrame) -> DataFrame:
    """(skein_doc, skein_version, skein_spans) of the documents that hold a span of which an earlier one is elsewhere."""
    before = len(made(docs.sparkSession))
    chunks = stash(code_spans(docs), "span-chunks")
    size = chunks.agg(F.sum("n").alias("spans"), F.count("*").alias("chunks"), F.max(F.col("chunk").bitwiseAND((1 << 24) - 1)).alias("last"), F.max(F.shiftright("chunk", 24)).alias("partition")).first()
    buckets, most = max(12, -(-(size.spans or 0) // BUCKET_SPANS)), 1 + (size.last or 0)
    tasks = max(8, min(2 * size.chunks, most * (1 + (size.partition or 0))))
    replies = stash(answer(ask(chunks, buckets), buckets), "span-replies")
    # Copies of a document may be in several chunks; they lose the same.
    return settled(covered(chunks, replies, buckets, most, tasks).dropDuplicates(["skein_doc", "skein_version"]), "gone", before)


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the parts of the spans; how many parts it had, and lost."""
    parts = sentences(text)
    if not spans:
        return text, len(parts), 0
    gone = {i for at, n in spans for i in range(at, min(at + n, len(parts)))}
    return "".join([x for i, x in enumerate(parts) if i not in gone]), len(parts), len(gone)


def remove_repeats(docs: DataFrame, counts: tuple[str, str] = ("n_sentences", "n_removed")) -> DataFrame:
    """All rows and columns, text without repeated passages; and as long, how many parts it had and lost."""
    gone = repeats(docs)
    rows = docs.withColumn("skein_text", F.xxhash64("text"))
    met = rows.join(gone, rows["doc_id"].cast("long").eqNullSafe(gone["skein_doc"]) & (rows["skein_text"] == gone["skein_version"]), "left")
    names = [f.name for f in docs.schema]
    added = free_names(counts, names)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + "".join(f", `{x}` bigint" for x in added)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("spans", dict)
        for batch in it:
            found, n, lost = [], [], []
            for x, spans in zip(batch.column("text").to_pylist(), batch.column("skein_spans").to_pylist(), strict=True):
                text, had, gone_here = (x, 0, 0) if x is None else cut(x, np.frombuffer(spans or b"", "<i4").reshape(-1, 2).tolist())
                found.append(text)
                n.append(had)
                lost.append(gone_here)
            cols = [pa.array(found, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(lost, pa.int64())], names=[*names, *added])

    return met.select(*[docs[c] for c in names], "skein_spans").mapInArrow(run, out)
