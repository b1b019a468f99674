"""Benchmark decontamination by greedy string tiling.

Documents and test items become sequences of lower-case word tokens. Runs of
min_match tokens of the items are the seeds; documents that share seeds with an
item are tiled against it: running Karp-Rabin matching finds common substrings
of a search length, the longest that overlap no earlier tile are marked first,
and the search length falls until it is min_match. An item whose marked share
reaches the threshold is contained in the document, also in another order.

Tokens in tiles are tokens of shared seeds, so an item of which these cover too few tokens is
not tiled: a phrase that all items have brings no document to all of them.

The test set is read in blocks of bounded size (BLOCK_CHARS of text). One block is
broadcast; of several, each is collected, held against all documents, its result
written, and released before the next is read, so a larger test set means more
passes and not more memory. Documents never leave their task.

Edge cases: an item of fewer than min_match tokens is contained where its whole token
sequence is; null and empty texts contain nothing, and items without tokens are in nothing;
an item with a null id counts like any other; equal rows of the test set count once, equal
rows of documents give equal result rows; of equally long matches the first in the document
is marked first, then the first in the item; very long documents are tiled only around their
seeds; either table may be empty; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import arrow_schema, batches, bounded_batches, forget, kept, stash, texts

MIN_MATCH = 5
THRESHOLD = 0.5
BLOCK_CHARS = 8_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
TOKEN = re.compile(r"\w+")
GAP = -2


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows, modulo 2**64."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    values, out = (ids + 3).astype(np.uint64), np.zeros(n, np.uint64)
    for k in range(size):
        out = out * BASE + values[k : k + n]
    return out


class Tiling:
    """Running Karp-Rabin greedy string tiling of an item (pattern) and a text."""

    def __init__(self, pattern: list[int], text: list[int], min_match: int):
        self.pattern, self.text, self.least = pattern, text, min_match
        self.used_p, self.used_t = [False] * len(pattern), [False] * len(text)
        self.tiles: list[tuple[int, int, int]] = []

    def _windows(self, values: list[int], used: list[bool], size: int) -> Iterator[tuple[int, int]]:
        """(start, hash) of each window without marked tokens, the hash rolled along."""
        mod, base = (1 << 61) - 1, 0x1F3D5B79
        top = pow(base, size - 1, mod)
        held, start = 0, 0
        for end, value in enumerate(values):
            if used[end] or value < 0:
                held, start = 0, end + 1
                continue
            if end - start == size:
                held = (held - (values[start] + 1) * top) % mod
                start += 1
            held = (held * base + values[end] + 1) % mod
            if end - start == size - 1:
                yield start, held

    def _search(self, size: int) -> tuple[int, list[tuple[int, int, int]]]:
        """(minus length, text, pattern) of unmarked matches of at least this length; stops at one twice as long."""
        at: dict[int, list[int]] = defaultdict(list)
        for p, h in self._windows(self.pattern, self.used_p, size):
            at[h].append(p)
        found: list[tuple[int, int, int]] = []
        for t, h in self._windows(self.text, self.used_t, size):
            for p in at.get(h, ()):
                n = 0
                while p + n < len(self.pattern) and t + n < len(self.text) and self.pattern[p + n] == self.text[t + n] and not self.used_p[p + n] and not self.used_t[t + n]:
                    n += 1
                if n > 2 * size:
                    return n, []
                if n >= size:
                    found.append((-n, t, p))
        return size, found

    def run(self) -> list[tuple[int, int, int]]:
        """Tiles (start in pattern, start in text, length)."""
        size = max(self.least, min(len(self.pattern), len(self.text), 20))
        while True:
            longer, found = self._search(size)
            if longer > size:
                size = longer
                continue
            for n, t, p in self._longest_first(found, size):
                self.used_p[p : p + n] = self.used_t[t : t + n] = [True] * n
                self.tiles.append((p, t, n))
            if size == self.least:
                return self.tiles
            size = max(self.least, size // 2)

    def _longest_first(self, found: list[tuple[int, int, int]], size: int) -> Iterator[tuple[int, int, int]]:
        """(length, text, pattern) of matches free of marks, longest first; what marks leave of a
        match goes back in line by its own length."""
        heapq.heapify(found)
        while found:
            n, t, p = heapq.heappop(found)
            free, start = [], 0
            for k in range(-n + 1):
                if k == -n or self.used_p[p + k] or self.used_t[t + k]:
                    if k - start >= size:
                        free.append((start - k, t + start, p + start))
                    start = k + 1
            if free == [(n, t, p)]:
                yield -n, t, p
            else:
                for x in free:
                    heapq.heappush(found, x)


class Items:
    """A block of test items, prepared for scanning documents."""

    def __init__(self, rows: list[tuple[int | None, str]], min_match: int):
        self.min_match = min_match
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int | None, list[int]]] = []
        #: Items of fewer tokens, by their tokens.
        self.short: dict[int, dict[tuple[int, ...], list[int | None]]] = {}
        for key, text in rows:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in tokens(text or "")]
            if len(ids) >= min_match:
                self.items.append((key, ids))
            elif ids:
                self.short.setdefault(len(ids), {}).setdefault(tuple(ids), []).append(key)
        hashes = [window_hashes(np.array(ids), min_match) for _, ids in self.items]
        size = np.array([len(ids) for _, ids in self.items], np.int64)
        #: All items' tokens stand in one row; a seed is held by the places where it starts there.
        self.begin, self.size = np.cumsum(size) - size, size
        self.owner = np.repeat(np.arange(len(size)), size)
        seeds = np.concatenate([np.zeros(0, np.uint64), *hashes])
        place = np.concatenate([np.zeros(0, np.int64), *[b + np.arange(len(h)) for b, h in zip(self.begin, hashes, strict=True)]])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.first = np.unique(seeds[order], return_index=True)
        self.places, self.last = place[order], np.append(self.first[1:], len(order))

    def _short(self, ids: np.ndarray) -> Iterator[tuple[int | None, int, int, list[tuple[int, int, int]]]]:
        """Short items that stand in a text as a whole, each with its first place."""
        for n, own in sorted(self.short.items()):
            seen = set()
            for at in np.flatnonzero(np.convolve(ids >= 0, np.ones(n), "valid") == n).tolist() if len(ids) >= n else ():
                found = tuple(ids[at : at + n].tolist())
                if found in own and found not in seen:
                    seen.add(found)
                    for key in own[found]:
                        yield key, n, n, [(0, at, n)]

    def scan(self, text: str, threshold: float = 0.0) -> Iterator[tuple[int | None, int, int, list[tuple[int, int, int]]]]:
        """(item, its tokens, marked tokens, tiles) of the items that share a seed with a text, but those
        whose shared seeds already cover less than the threshold, and of short items in it."""
        get = self.vocabulary.get
        words = tokens(text)
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        if self.short:
            yield from self._short(ids)
        if len(ids) < self.min_match or not len(self.seeds):
            return
        known = np.cumsum(np.concatenate([[0], ids >= 0]))
        whole = np.flatnonzero(known[self.min_match :] - known[: -self.min_match] == self.min_match)
        if not len(whole):
            return
        hashes = np.zeros(len(whole), np.uint64)
        for k in range(self.min_match):
            hashes = hashes * BASE + (ids[whole + k] + 3).astype(np.uint64)
        at = np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)
        hit = self.seeds[at] == hashes
        if not hit.any():
            return
        starts, seed = whole[hit], at[hit]
        used, which = np.unique(seed, return_inverse=True)
        of_seed = np.repeat(np.arange(len(used)), self.last[used] - self.first[used])
        held = np.concatenate([self.places[self.first[k] : self.last[k]] for k in used])
        covered = np.unique(held[:, None] + np.arange(self.min_match))
        most = np.bincount(self.owner[covered], minlength=len(self.size))
        near = np.flatnonzero((most > 0) & (most >= threshold * self.size))
        for item in near.tolist():
            key, pattern = self.items[item]
            shared = np.zeros(len(used), bool)
            shared[of_seed[self.owner[held] == item]] = True
            part, places, end = [], [], -1
            for start in starts[shared[which]].tolist():
                if start > end and part:
                    part.append(GAP)
                    places.append(-1)
                for p in range(max(start, end), start + self.min_match):
                    part.append(int(ids[p]))
                    places.append(p)
                end = start + self.min_match
            tiles = Tiling(pattern, part, self.min_match).run()
            yield key, len(pattern), sum(n for _, _, n in tiles), [(p, places[t], n) for p, t, n in tiles]


def item_blocks(benchmark: DataFrame) -> tuple[int, Iterator]:
    """How many blocks of (item_id, text) the test set has, of about BLOCK_CHARS each, and one after another as a broadcast."""
    spark = benchmark.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).where("item_text IS NOT NULL")
    size = items.agg(F.sum(F.length("item_text")).alias("n")).first().n or 0
    blocks = max(1, -(-size // BLOCK_CHARS))

    def each() -> Iterator:
        for k in range(blocks):
            rows = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == k)
            found = [(r.item_id, r.item_text) for r in rows.distinct().collect()]
            yield spark.sparkContext.broadcast(sorted(found, key=lambda x: (x[0] is not None, x[0] or 0, x[1])))

    return blocks, each()


def prepared(block, min_match: int) -> Items:
    """The items of a broadcast block, kept by the worker."""
    return kept(f"items-{block._path}-{min_match}", lambda: Items(block.value, min_match))


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, item_tokens, covered, coverage, tiles) of every document and item
    where tiles cover at least the threshold of the item's tokens. tiles: starts in the
    item and in the document's tokens, and the length, as `item:document:length` parts."""
    ddl = "doc_id long, item_id long, item_tokens long, covered long, coverage double, tiles string"

    def scan(block) -> DataFrame:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema, own = arrow_schema(ddl), prepared(block, min_match)
            for batch in it:
                rows = {n: [] for n in schema.names}
                for doc, x in zip(batch.column("row_key").to_pylist(), texts(batch, "row_text"), strict=True):
                    for item, n, covered, tiles in own.scan(x, threshold):
                        if covered >= threshold * n:
                            for c, v in zip(schema.names, (doc, item, n, covered, covered / n, " ".join("%d:%d:%d" % t for t in tiles)), strict=True):
                                rows[c].append(v)
                yield batches(rows, schema)

        return docs.select(F.col(key).cast("long").alias("row_key"), F.col(text).alias("row_text")).mapInArrow(run, ddl)

    blocks, each = item_blocks(benchmark)
    if blocks == 1:
        return scan(next(each))
    found = None
    for block in each:
        part = stash(scan(block), "leaks")
        block.unpersist(blocking=True)
        found = part if found is None else found.unionByName(part)
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose text contains no test item."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def scan(block, docs: DataFrame) -> DataFrame:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = prepared(block, min_match)
            for batch in it:
                keep = [not any(covered >= threshold * n for _, n, covered, _ in own.scan(x, threshold)) for x in texts(batch, "text")]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return docs.mapInArrow(run, ddl)

    blocks, each = item_blocks(benchmark)
    if blocks == 1:
        return scan(next(each), docs)
    for block in each:
        left = stash(scan(block, docs), "left")
        block.unpersist(blocking=True)
        forget(docs)
        docs = left
    return docs
