"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2h bits have a common variant within h
bits of both. Every distinct fingerprint stands for all its variants within
half the radius; variants are dealt to buckets by a linear hash, and since a
variant is its fingerprint xor one of a fixed set of masks, a fingerprint is
sent once to each bucket that holds variants of it and they are made there, in
passes of bounded size. Equal variants in a bucket are colliding pairs. All
fingerprints with one variant are within the radius of each other, so a chain
through them loses no link; links are checked by their bit count and reduced to
a spanning forest in the bucket before they are shuffled again.

Equal texts have equal fingerprints and are grouped before that, so the size of
a group of copies does not matter.

Linking by similarity (one_of_each) takes one more step. Texts of Jaccard similarity
0.8 differ in about 15 of 100 bits, beyond any ball of 64. So a text has FAMILIES
independent prints of NARROW bits, and balls of each family are joined; a pair has
to meet in one of them. Pairs that meet are checked by all bits of both and
then by the exact similarity of their shingles. A family gives only a forest of the pairs it
has met, those of the nearest bits, and the texts nearest to the middle of a large group
are met with all of it. Where exact similarity then leaves such a forest's texts
apart, all of them are compared, so no link is lost; a group of copies costs its size. Texts of a
forest are sent to one task; of a large one, its blocks are met two by two. Two texts of the
similarity share one of the rarest shingles of both (as many as may differ, and one), so only those are compared.

A family is one bucket while its sketches fit; beyond, sketches are dealt to cells: prints that differ in at
most radius bits agree in one of radius + 1 fields, so a sketch is sent to the cell of each field's value,
whatever the number of cells, and a family is met and written before the next is sent.

Edge cases: null and empty texts have fingerprint zero and are linked like any
other; fewer words than a shingle give one shingle of all words; the table may
be empty; doc_id is the only other column that is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import arrow_schema, batches, bounded_batches, kept, made, release, settled, stash
from skein.llm.links import components

BITS = 64
BUCKETS = 64
#: Fingerprints that one bucket may hold (20 bytes each while it works); beyond, there are more buckets.
BUCKET_PRINTS = 16_000_000
#: The same for sketches, of about 110 bytes: a family of more is dealt to cells of half as many.
BUCKET_SKETCHES = 2_000_000
#: Variants made at a time in a bucket.
PASS_VARIANTS = 2_000_000
PIECE = 500_000
#: Similar texts: independent prints of a text, the bits of each, and those of all together.
FAMILIES, NARROW = 16, 36
SKETCH = FAMILIES * NARROW
#: Sketches of texts of similarity 0.8 differ in 87 bits or so, up to 109 in short texts, of others in 288;
#: 180 is more than seven standard deviations from both.
SKETCH_RADIUS = 180
#: Pairs that a bucket holds before it keeps only a forest of them.
HELD_PAIRS = 4_000_000
#: Of a group so many texts nearest to its middle are met with all others.
CENTRES = 3
#: Bytes of shingles in a block of a forest, as far as it goes by the mean; two blocks are met in a task. A forest
#: of more than SPREAD_BYTES is cut into up to SPREAD blocks anyway, so that several tasks share its work.
BLOCK_BYTES, SPREAD_BYTES, SPREAD = 16 << 20, 1 << 20, 4
#: Equal variants of which all pairs are listed at once; of more, neighbours only.
LONG_RUN = 8


def fingerprint(text: str, words: int) -> int:
    """Majority bits of the XXH64 hashes (seed 42) of all word shingles; zero without words."""
    parts = text.encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not parts:
        return 0
    line = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    n = max(1, len(parts) - words + 1)
    starts, stops = (ends - size)[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, PIECE):
        cut = map(slice, starts[at : at + PIECE], stops[at : at + PIECE])
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, cut), repeat(42)), np.uint64, min(PIECE, n - at))
        ones += np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, print) of every row; print is the 64 bits as a signed long."""
    bounded_batches(docs.sparkSession)
    ddl = "doc_id long, print long"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        kept("simhash", dict)
        for batch in it:
            found = [fingerprint(x or "", words) for x in batch.column("row_text").to_pylist()]
            yield batches({"doc_id": batch.column("doc_id"), "print": found}, schema)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("row_text")).mapInArrow(run, ddl)


def ball(radius: int, width: int = BITS) -> np.ndarray:
    """All masks of at most radius of width bits."""
    return np.array([sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)], np.uint64)


class LinearHash:
    """xor of a random word for each set bit, so the hash of f ^ m is that of f xor that of m."""

    def __init__(self, bits: int):
        rng = np.random.default_rng(64)
        rows = rng.integers(0, 1 << 32, BITS, np.uint64) & np.uint64((1 << bits) - 1)
        self.tables = np.zeros((8, 256), np.uint64)
        for byte in range(8):
            for value in range(256):
                self.tables[byte, value] = np.bitwise_xor.reduce(rows[byte * 8 : byte * 8 + 8][[bool(value >> b & 1) for b in range(8)]], initial=np.uint64(0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        parts = x.astype("<u8").view(np.uint8).reshape(-1, 8)
        out = self.tables[0][parts[:, 0]]
        for byte in range(1, 8):
            out ^= self.tables[byte][parts[:, byte]]
        return out.astype(np.int64)


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the links (i, j): every component has its smallest index."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return label
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting in place."""
    values.sort()
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def met_variants(prints: np.ndarray, masks: np.ndarray, bits: int, bucket: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Variants of a bucket that more than one row has, and the places of their rows, in passes of bounded size.

    A pass has the variants whose hash has certain further bits. Rows are ordered by
    their hash, so each mask meets a run of them, and no pass walks the others.
    """
    deal = LinearHash(32)
    more = max(0, int(np.ceil(np.log2(max(1.0, len(prints) * len(masks) / 2**bits / PASS_VARIANTS)))))
    keep = (1 << (bits + more)) - 1
    of_mask, of_print = deal(masks) & keep, (deal(prints) & keep).astype(np.uint32)
    order = np.argsort(of_print, kind="stable").astype(np.uint32)
    offset = np.concatenate(([0], np.cumsum(np.bincount(of_print, minlength=keep + 1))))
    del of_print
    for extra in range(1 << more):
        need = of_mask ^ (bucket | extra << bits)
        count = offset[need + 1] - offset[need]
        total = int(count.sum())
        at = order[np.repeat(offset[need] - np.cumsum(count) + count, count) + np.arange(total)]
        variants = prints[at] ^ np.repeat(masks, count)
        # One sort of the variants, or of a hash of them, with their places behind it finds those that are not alone.
        room = 63 - total.bit_length()
        keys = variants if width <= room else (variants ^ variants >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - room)
        keys = keys << np.uint64(63 - room) | np.arange(total, dtype=np.uint64)
        keys.sort()
        same = (keys[1:] ^ keys[:-1]) >> np.uint64(63 - room) == 0
        met = (keys[np.concatenate((same, [False])) | np.concatenate(([False], same))] & np.uint64((1 << (63 - room)) - 1)).astype(np.int64) if total else np.zeros(0, np.int64)
        yield variants[met], at[met].astype(np.int64)


def bucket_links(prints: np.ndarray, masks: np.ndarray, radius: int, bits: int, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a bucket: (print, smallest print of its component here), for sorted distinct prints."""
    label = np.arange(len(prints))
    for variants, at in met_variants(prints, masks, bits, bucket, BITS):
        order = np.argsort(variants)
        variants, at = variants[order], at[order]
        same = np.flatnonzero(variants[1:] == variants[:-1])
        i, j = at[same], at[same + 1]
        close = np.bitwise_count(prints[i] ^ prints[j]) <= radius
        label = joined(label, i[close], j[close])
    moved = np.flatnonzero(label != np.arange(len(prints)))
    return prints[moved], prints[label[moved]]


def buckets_for(rows: int, masks: int, least: int, most_rows: int) -> int:
    """A power of two of buckets of which none holds more than so many rows, as far as it goes by the mean."""
    buckets = least
    while rows * min(1.0, masks / buckets) > most_rows:
        buckets *= 2
    return buckets


def ball_links(prints: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between distinct prints (one column) that span every pair within the radius."""
    if radius % 2:
        raise ValueError("the radius must be even: half of it is the ball's")
    masks = ball(radius // 2)
    buckets = buckets_for(prints.count(), len(masks), BUCKETS, BUCKET_PRINTS)
    bits = buckets.bit_length() - 1

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, deal = arrow_schema("bucket int, blob binary"), LinearHash(32)
        of_mask = np.unique(deal(masks) & (buckets - 1))
        for batch in it:
            own = batch.column("print").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if len(of_mask) == buckets:  # every print has variants in every bucket
                for at in range(0, buckets, 64):
                    ids = list(range(at, min(at + 64, buckets)))
                    yield batches({"bucket": ids, "blob": [own.tobytes()] * len(ids)}, schema)
                continue
            for at in range(0, len(own), 500):
                part = own[at : at + 500]
                to = (deal(part) & (buckets - 1))[:, None] ^ of_mask[None, :]
                flat = to.ravel()
                order = np.argsort(flat, kind="stable")
                ids, starts = np.unique(flat[order], return_index=True)
                rows = np.split(np.repeat(part, len(of_mask))[order], starts[1:])
                yield batches({"bucket": ids, "blob": [r.tobytes() for r in rows]}, schema)

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held = arrow_schema("a long, b long"), {}
        kept("simhash", dict)
        for batch in it:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
                held.setdefault(bucket, []).append(np.frombuffer(blob.as_buffer(), np.uint64).copy())
        for bucket in sorted(held):
            own = distinct(np.concatenate(held.pop(bucket)))
            a, b = bucket_links(own, masks, radius, bits, bucket)
            for at in range(0, len(a), 100_000):
                yield batches({"a": a[at : at + 100_000].view(np.int64), "b": b[at : at + 100_000].view(np.int64)}, schema)

    sent = prints.select("print").mapInArrow(send, "bucket int, blob binary")
    return sent.repartitionById(buckets, "bucket").mapInArrow(meet, "a long, b long")


def groups(prints: DataFrame, radius: int) -> DataFrame:
    """(doc_id, print, component_id) of a table (doc_id, print): the smallest doc_id that links reach."""
    distinct = stash(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(ball_links(distinct, radius))
    marked = stash(distinct.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print")), "roots")
    names = marked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = marked.join(names, "root").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", "print", "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    before = len(made(docs.sparkSession))
    prints = stash(fingerprints(docs, words), "doc-prints")
    found = groups(prints, radius).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
    return settled(found, "near-duplicates", before)


def shingles(text: str, words: int) -> np.ndarray:
    """XXH64 hashes (seed 42) of the distinct word shingles, sorted; none without words."""
    parts = text.encode().lower().split()
    found = {xxhash.xxh64_intdigest(b" ".join(parts[i : i + words]), 42) for i in range(max(1, len(parts) - words + 1))} if parts else set()
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """SplitMix64 of the hashes: other bits of the same shingles."""
    x = hashes + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(hashes: np.ndarray) -> bytes:
    """SKETCH majority bits of a set of shingles: FAMILIES prints of NARROW bits one after another."""
    ones = np.zeros(SKETCH, np.int64)
    for at in range(0, len(hashes), PIECE):
        for k in range(SKETCH // BITS):
            part = mixed(hashes[at : at + PIECE], k).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
            ones[k * BITS : (k + 1) * BITS] += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes()


def text_nodes(docs: DataFrame, words: int, sets: bool = False) -> DataFrame:
    """(doc_id, node, data) of every row: node is a hash of the words, which copies share;
    data the sketch of the shingles, or with sets their hashes."""
    bounded_batches(docs.sparkSession)
    ddl = "doc_id long, node long, data binary"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        kept("simhash", dict)
        for batch in it:
            nodes, data = [], []
            for x in batch.column("row_text").to_pylist():
                line = b" ".join((x or "").encode().lower().split())
                nodes.append(xxhash.xxh3_64_intdigest(line) - (1 << 63))
                own = shingles(x or "", words)
                data.append(own.tobytes() if sets else sketch(own))
            yield batches({"doc_id": batch.column("doc_id"), "node": nodes, "data": data}, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("row_text")).mapInArrow(run, ddl)


def narrow_prints(rows: np.ndarray, family: int) -> np.ndarray:
    """The prints of one family, of sketches as rows of bytes."""
    bits = np.unpackbits(rows, axis=1, bitorder="little")[:, family * NARROW : (family + 1) * NARROW]
    wide = np.zeros((len(rows), BITS), np.uint8)
    wide[:, :NARROW] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def run_pairs(keys: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of equal keys. Of more than LONG_RUN equal keys only neighbours, by their ids, are paired."""
    order = np.lexsort((ids[at], keys))
    keys, at = keys[order], at[order]
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    size = np.diff(edge)
    start, stop = edge[:-1][size > 1], edge[1:][size > 1]
    most = np.where(stop - start > LONG_RUN, 1, stop - start - 1)
    found_i, found_j, step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
    while len(start):
        reach = stop - start - step
        i = np.repeat(start, reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        x, y = at[i], at[i + step]
        found_i.append(np.minimum(x, y))
        found_j.append(np.maximum(x, y))
        step += 1
        more = most >= step
        start, stop, most = start[more], stop[more], most[more]
    return np.concatenate(found_i), np.concatenate(found_j)


def forest(n: int, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the links (i, j) of n rows make a forest of the least weights: every component takes its lightest
    link to another, until there is none."""
    order = np.argsort(weight, kind="stable")
    i, j, label, chosen = i[order], j[order], np.arange(n), []
    left = np.arange(len(i))
    while True:
        a, b = label[i[left]], label[j[left]]
        left, a, b = left[a != b], a[a != b], b[a != b]
        if not len(left):
            return order[np.unique(np.concatenate(chosen))] if chosen else order[:0]
        best = np.full(n, len(i))
        np.minimum.at(best, a, left)
        np.minimum.at(best, b, left)
        some = np.unique(best[best < len(i)])
        chosen.append(some)
        label = joined(label, i[some], j[some])


def centre_pairs(rows: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the rows of each large component with those nearest to its middle, which has the bits that most of them have."""
    order = np.argsort(label, kind="stable")
    start = np.flatnonzero(np.diff(label[order], prepend=-1))
    size = np.diff(start, append=len(order))
    found = [np.zeros((0, 2), np.int64)]
    for s, n in zip(start[size > LONG_RUN].tolist(), size[size > LONG_RUN].tolist(), strict=True):
        own = order[s : s + n]
        ones = np.zeros(rows.shape[1] * 8, np.int64)
        for at in range(0, n, PIECE // 10):
            ones += np.unpackbits(rows[own[at : at + PIECE // 10]], axis=1).sum(axis=0, dtype=np.int64)
        middle = np.packbits(ones * 2 > n)
        far = np.bitwise_count(rows[own] ^ middle).sum(axis=1, dtype=np.int64)
        for centre in own[np.argsort(far, kind="stable")[:CENTRES]]:
            found.append(np.stack([np.minimum(own, centre), np.maximum(own, centre)], axis=1)[own != centre])
    both = np.concatenate(found)
    return both[:, 0], both[:, 1]


def family_pairs(rows: np.ndarray, ids: np.ndarray, family: int, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs of one family whose balls (of these masks) meet and whose sketches are near enough."""
    n, wide = len(rows), rows.view("<u8")

    def apart(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        parts = [np.bitwise_count(wide[i[k : k + PIECE]] ^ wide[j[k : k + PIECE]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), PIECE)]
        return np.concatenate([np.zeros(0, np.int64), *parts])

    def pruned(pairs: np.ndarray) -> np.ndarray:
        i, j = pairs // max(n, 1), pairs % max(n, 1)
        return pairs[forest(n, i, j, apart(i, j))]

    found, held = [np.zeros(0, np.int64)], 0
    for variants, at in met_variants(narrow_prints(rows, family), masks, 0, 0, NARROW):
        i, j = run_pairs(variants, at, ids)
        pairs = distinct(i * n + j)
        found.append(pairs[apart(pairs // n, pairs % n) <= SKETCH_RADIUS] if len(pairs) else pairs)
        held += len(found[-1])
        if held > HELD_PAIRS:  # a forest of a forest and more links is that of all
            found = [pruned(distinct(np.concatenate(found)))]
            held = len(found[0])
    pairs = distinct(np.concatenate(found))
    i, j = pairs // max(n, 1), pairs % max(n, 1)
    a, b = centre_pairs(rows, joined(np.arange(n), i, j))
    near = apart(a, b) <= SKETCH_RADIUS
    i, j = np.concatenate((i, a[near])), np.concatenate((j, b[near]))
    chosen = forest(n, i, j, apart(i, j))
    return i[chosen], j[chosen]


def near_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b): pairs of nodes of a table (node, data) whose balls meet in one family at least, a forest of each bucket.

    A family of more than BUCKET_SKETCHES is met in cells, by its own shuffle, which is written before the next.
    """
    rows = nodes.count()
    if rows <= BUCKET_SKETCHES:
        return met_sketches(nodes, range(FAMILIES), radius, 1, 0)
    fields = radius + 1
    width = min(NARROW // fields, int(np.ceil(np.log2(2 * rows / BUCKET_SKETCHES))))
    found = None
    for family in range(FAMILIES):
        own = stash(met_sketches(nodes, range(family, family + 1), radius, fields, width), "family-pairs")
        release(nodes.sparkSession)
        found = own if found is None else found.unionByName(own)
    return found


def met_sketches(nodes: DataFrame, families: range, radius: int, fields: int, width: int) -> DataFrame:
    """The pairs of some families, whose sketches are dealt by the values of so many fields of so many bits."""
    ddl, cells = "bucket int, blob binary", fields << width
    low, ball_masks = np.uint64((1 << width) - 1), ball(radius // 2, NARROW)
    # Prints of a cell differ outside its field only.
    masks_of = [ball_masks[ball_masks & (low << np.uint64(f * width)) == 0] for f in range(fields)]

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for batch in it:
            ids = batch.column("node").to_numpy(zero_copy_only=False).astype("<i8")
            data = np.frombuffer(b"".join(batch.column("data").to_pylist()), np.uint8).reshape(len(ids), -1)
            rows = np.concatenate((ids.view(np.uint8).reshape(-1, 8), data), axis=1)
            for place, family in enumerate(families):
                prints = narrow_prints(data, family)
                for field in range(fields):
                    value = (prints >> np.uint64(field * width) & low).astype(np.int64)
                    order = np.argsort(value, kind="stable")
                    found, starts = np.unique(value[order], return_index=True)
                    blobs = [x.tobytes() for x in np.split(rows[order], starts[1:])]
                    if len(ids):
                        yield batches({"bucket": place * cells + (field << width) + found, "blob": blobs}, schema)

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held = arrow_schema("a long, b long"), {}
        kept("simhash", dict)
        for batch in it:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                held.setdefault(bucket, []).append(blob)
        for bucket in sorted(held):
            rows = np.frombuffer(b"".join(held.pop(bucket)), np.uint8).reshape(-1, 8 + SKETCH // 8)
            ids = np.ascontiguousarray(rows[:, :8]).view("<i8").ravel()
            i, j = family_pairs(np.ascontiguousarray(rows[:, 8:]), ids, families[bucket // cells], masks_of[(bucket % cells) >> width])
            for at in range(0, len(i), 100_000):
                x, y = ids[i[at : at + 100_000]], ids[j[at : at + 100_000]]
                yield batches({"a": np.minimum(x, y), "b": np.maximum(x, y)}, schema)

    sent = nodes.select("node", "data").mapInArrow(send, ddl)
    return sent.repartitionById(len(families) * cells, "bucket").mapInArrow(meet, "a long, b long")


def similar_links(sets: list[np.ndarray], labels: np.ndarray, side: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """Links (i, j) of at least that similarity that join labels which those before them leave apart, between texts of
    both sides, or among all where there is one side. Shingles of a set are distinct."""
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    names, token, many = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    rare = np.empty(len(names), np.int64)
    rare[np.argsort(many, kind="stable")] = np.arange(len(names))
    row = np.repeat(np.arange(n), size)
    token = rare[token]
    token = token[np.lexsort((token, row))]  # of each text, the rarest first
    start = np.concatenate(([0], np.cumsum(size)))
    # Of s shingles at least least * s are shared, so one of the rarest s - that + 1 of both is.
    front = size - np.ceil(least * size - 1e-9).astype(np.int64) + 1
    first = np.arange(len(token)) - start[row] < front[row]
    order = np.argsort(token[first], kind="stable")
    holder = row[first][order]
    edge = np.searchsorted(token[first][order], np.arange(len(names) + 1))
    mark, label = np.zeros(len(names), bool), np.unique(labels, return_inverse=True)[1]
    found_i, found_j = [], []

    def runs(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())

    two = len(np.unique(side)) > 1
    for i in range(n):
        own = token[start[i] : start[i + 1]]
        asked = own[: front[i]]
        met = np.unique(holder[runs(edge[asked], edge[asked + 1] - edge[asked])]) if len(own) else own
        met = met[(met < i) & (label[met] != label[i]) & (np.minimum(size[met], size[i]) >= least * np.maximum(size[met], size[i]))]
        if two:
            met = met[side[met] != side[i]]
        if not len(met):
            continue
        mark[own] = True
        both = np.add.reduceat(mark[token[runs(start[met], size[met])]], np.cumsum(size[met]) - size[met], dtype=np.int64)
        mark[own] = False
        for j in met[both / (size[met] + size[i] - both) >= least].tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                found_i.append(i)
                found_j.append(j)
    return found_i, found_j


def near_links(parts: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links of at least that similarity between nodes of a table (node, group, label, blocks) of one group
    and different labels, by their shingles (node, data); of each group all pairs are compared, and a link is left
    out where those before it join the same. A group's nodes are cut into blocks, and each two blocks meet in a task."""

    def meet(table: pa.Table) -> pa.Table:
        kept("simhash", dict)
        ids, labels, side = (table.column(c).to_numpy() for c in ("node", "label", "block"))
        i, j = similar_links([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("data")], labels, side, least)
        return pa.table({"a": np.minimum(ids[i], ids[j]) if i else ids[:0], "b": np.maximum(ids[i], ids[j]) if i else ids[:0]})

    own = F.pmod(F.xxhash64("node"), "blocks")
    dealt = parts.select("node", "group", "label", own.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("node", "group", "label", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    return dealt.join(sets.hint("merge"), "node").groupBy("group", "p", "q").applyInArrow(meet, "a long, b long")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingles have at least that Jaccard similarity. The shingles (node, data) of
    all their nodes are its attribute skein_sets."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = nodes.join(ends.hint("merge"), "node").select(F.col("least").alias("skein_id")).distinct()
    rows = docs.join(ids.hint("merge"), docs["doc_id"].cast("long") == ids["skein_id"], "left_semi")
    sets = stash(text_nodes(rows, words, sets=True).groupBy("node").agg(F.first("data").alias("data")), "near-texts")
    one, two = sets.select(F.col("node").alias("a"), F.col("data").alias("x")), sets.select(F.col("node").alias("b"), F.col("data").alias("y"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("a long, b long")
        kept("simhash", dict)
        for batch in it:
            x, y = batch.column("x"), batch.column("y")
            near = [similarity(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)) >= least for i in range(batch.num_rows)]
            held = batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))
            yield batches({"a": held.column("a"), "b": held.column("b")}, schema)

    out = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")
    out.skein_sets = sets
    return out


def similar_groups(docs: DataFrame, words: int, radius: int, least: float) -> DataFrame:
    """(doc_id, component_id) of rows with a doc_id: the smallest doc_id that links of the
    similarity reach. First forests of near pairs are verified; where they leave texts of one forest apart,
    all its pairs that are still apart are compared."""
    prints = stash(text_nodes(docs, words), "doc-sketches")
    nodes = stash(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("data").alias("data")), "sketches")
    found = stash(near_pairs(nodes, radius).distinct(), "near-pairs")
    release(docs.sparkSession)
    checked = verified(docs, nodes, found, words, least)
    links, sets = stash(checked, "near-links"), checked.skein_sets
    release(docs.sparkSession)
    roots = stash(components(links), "near-roots")
    # Texts of one forest that verified links leave in several parts.
    sizes = sets.select("node", (F.length("data") + 64).cast("long").alias("bytes"))
    parts = components(found).withColumnRenamed("root", "group").join(roots.hint("merge"), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    parts = stash(parts.join(sizes.hint("merge"), "node"), "near-parts")
    blocks = F.greatest(F.ceil(F.sum("bytes") / BLOCK_BYTES), F.least(F.ceil(F.sum("bytes") / SPREAD_BYTES), F.lit(SPREAD).cast("long")))
    split = parts.groupBy("group").agg(F.min("label").alias("one"), F.max("label").alias("other"), blocks.alias("blocks")).where("one <> other").select("group", "blocks")
    apart = stash(parts.join(split.hint("merge"), "group").select("node", "group", "label", "blocks"), "near-rest")
    if apart.limit(1).count():
        more = stash(near_links(apart, sets, least), "near-links")
        roots = components(links.unionByName(more))
        release(docs.sparkSession)
    marked = stash(nodes.select("node", "least").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    names = marked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = marked.join(names.hint("merge"), "root").select("node", "component_id")
    return prints.select("doc_id", "node").join(named.hint("merge"), "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, radius: int = 4, least: float = 0.8) -> DataFrame:
    """The rows, with all their columns, without near-duplicates: texts whose shingles have
    at least that Jaccard similarity are linked, and of every group the
    document with the smallest doc_id stays. Rows that repeat a doc_id count as copies
    of it and one stays; rows without doc_id stay, as nothing else tells them apart."""
    before = len(made(docs.sparkSession))
    best = similar_groups(docs.where("doc_id IS NOT NULL"), words, radius, least).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("copies"))
    best = settled(best.select(F.col("doc_id").alias("skein_id"), "copies"), "kept", before)
    # A sort-merge join at every size: the kept ids grow with the documents.
    kept_rows = docs.join(best.hint("merge"), docs["doc_id"] == best["skein_id"], "left_semi")
    if best.where("copies > 1").limit(1).count():
        kept_rows = kept_rows.dropDuplicates(["doc_id"])
    return kept_rows.unionByName(docs.where("doc_id IS NULL"))
