"""WARC archives with a two-level capture index.

Records are written as gzip members into files of bounded size in the shared
folder. Captures are keyed by their URL with the host reversed, range-sorted
into shards, and written as compressed blocks; a sparse directory keeps each
block's first key, place and length. A lookup finds its shard among the shards'
first keys, binary-searches the shard's directory, reads one block, searches it
and reads the record's byte range.

Files are written by tasks under a new name at each attempt, and only the
places that a finished task returned are used, so a lost executor leaves at
most files that nothing refers to.

Of pages with the same payload the one with the largest page_id is a response
and the others are revisits; rows that repeat that page_id are responses too.

Edge cases: null html is an empty payload; null page_ids sort first and are
written as `-`; a null URL has the key `)`; equal keys are all found; an empty
table makes no files; other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import arrow_schema, batches, bounded_batches, fresh, made, settled, stash

FILE_BYTES = 64 << 20
BLOCK_LINES = 3000
#: Records that a shard of the index refers to, about.
SHARD_BYTES = 32 << 20
HELD_BLOCKS = 8
DATE = "2026-01-01T00:00:00Z"
STAMP = "20260101000000"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def surt(url: str | None) -> str:
    """Sort-friendly key of a URL: labels of the host reversed, then path and query; no scheme, user or fragment."""
    rest = re.sub(r"^[^/?#]*://", "", url or "").split("#", 1)[0]
    host, path = re.match(r"([^/?]*)(.*)", rest, re.DOTALL).groups()
    host, _, port = host.rpartition("@")[2].lower().partition(":")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + path
    return re.sub(r"\s", lambda m: "%%%02X" % ord(m[0]), key)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_name(page: int | None) -> str:
    return "-" if page is None else str(page)


def capture_key(url: str | None, page: int | None) -> str:
    """Order of captures: key, time, page."""
    return f"{surt(url)} {STAMP} {0 if page is None else page + (1 << 63) + 1:020d}"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response, or a revisit that keeps only the HTTP head."""
    block = (HTTP % len(payload)).encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_name(page)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: "%%%02X" % ord(m[0]), url))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{page_name(refers_to)}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("the record is cut off")
    return fields, block


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if re.match(r"\w+:", uri) else (pafs.LocalFileSystem(), uri)


class Sink:
    """Files of bounded size in a folder, each under a new name."""

    def __init__(self, folder: str, kind: str):
        self.fs, self.folder = file_system(folder)
        self.kind, self.out, self.name, self.at = kind, None, "", 0

    def write(self, data: bytes) -> tuple[str, int]:
        """File and offset of what is written."""
        if self.out is None or self.at and self.at + len(data) > FILE_BYTES:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.{self.kind}", 0
            self.fs.create_dir(self.folder, recursive=True)
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        place = self.name, self.at
        self.out.write(data)
        self.at += len(data)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class Reader:
    """Byte ranges of a folder's files; few files stay open."""

    def __init__(self, folder: str):
        self.fs, self.folder = file_system(folder)
        self.open: OrderedDict[str, pa.NativeFile] = OrderedDict()

    def read(self, name: str, at: int, n: int) -> bytes:
        f = self.open.pop(name, None) or self.fs.open_input_file(f"{self.folder}/{name}")
        self.open[name] = f
        if len(self.open) > 16:
            self.open.popitem(last=False)[1].close()
        f.seek(at)
        return f.read(n)


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, response_id, revisit) of every page; response_id is that of its payload."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    marks = stash(rows.select("page_id", F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("n")), "digests")
    firsts = marks.where(F.col("n") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("response_id"), F.count("*").alias("copies")).where("copies > 1 AND response_id IS NOT NULL")
    later = marks.join(firsts, "sha1").where("page_id IS NULL OR page_id < response_id").select("page_id", "sha1", "response_id").distinct()
    later = later.withColumnsRenamed({"page_id": "later_id", "sha1": "later_sha1"})
    met = rows.join(later, rows["page_id"].eqNullSafe(later["later_id"]) & (F.sha1(html.cast("binary")) == later["later_sha1"]), "left")
    return met.select("page_id", "url", "html", "response_id", F.col("later_sha1").isNotNull().alias("revisit"))


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Write all pages as records; (key, file, at, n) of every capture."""
    ddl = "key string, file string, at long, n long"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, sink = arrow_schema(ddl), Sink(folder, "warc.gz")
        for batch in it:
            rows = {n: [] for n in schema.names}
            for page, url, html, refers_to, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "response_id", "revisit")), strict=True):
                data = gzip.compress(record(page, url, (html or "").encode(), refers_to, revisit), 1, mtime=0)
                file, at = sink.write(data)
                for c, v in zip(schema.names, (capture_key(url, page), file, at, len(data)), strict=True):
                    rows[c].append(v)
            yield batches(rows, schema)
        sink.close()

    return stash(marked.mapInArrow(run, ddl), "captures")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Range-sort captures into shards of blocks; the directory (shard, first, last, file, at, n)."""
    ddl = "shard string, first string, last string, file string, at long, n long"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, sink, shard, lines = arrow_schema(ddl), Sink(folder, "cdx.gz"), uuid.uuid4().hex, []

        def block(part: list[str]) -> pa.RecordBatch:
            data = gzip.compress("\n".join(part).encode(), 6, mtime=0)
            file, at = sink.write(data)
            return batches({"shard": [shard], "first": [part[0].split("\t")[0]], "last": [part[-1].split("\t")[0]], "file": [file], "at": [at], "n": [len(data)]}, schema)

        for batch in it:
            lines += ["%s\t%s\t%d\t%d" % x for x in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "at", "n")), strict=True)]
            while len(lines) >= BLOCK_LINES:
                yield block(lines[:BLOCK_LINES])
                del lines[:BLOCK_LINES]
        if lines:
            yield block(lines)
        sink.close()

    # Records are read back shard by shard, so their bytes tell how many shards there are.
    spark = captures.sparkSession
    size = captures.agg(F.sum("n").alias("n")).first().n or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    return stash(captures.repartitionByRange(shards, "key").sortWithinPartitions("key").mapInArrow(run, ddl), "directory")


FOUND = "key string, page string, payload_bytes long, payload_digest string, record_type string, refers_to string"


class Directory:
    """Lookups in one shard: its sorted blocks, and few decompressed ones."""

    def __init__(self, blocks: list[tuple[str, str, str, int, int]], index_folder: str):
        self.blocks = sorted(blocks)
        self.firsts = [b[0] for b in self.blocks]
        self.reader, self.held = Reader(index_folder), OrderedDict()

    def lines(self, i: int) -> list[str]:
        found = self.held.pop(i, None)
        if found is None:
            _, _, file, at, n = self.blocks[i]
            found = gzip.decompress(self.reader.read(file, at, n)).decode().split("\n")
        self.held[i] = found
        if len(self.held) > HELD_BLOCKS:
            self.held.popitem(last=False)
        return found

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """Places of all captures with a key, which may run over several blocks."""
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.blocks) and self.blocks[i][0] <= key:
            if key <= self.blocks[i][1]:
                lines = self.lines(i)
                k = bisect.bisect_left(lines, key + "\t")
                while k < len(lines) and lines[k].startswith(key + "\t"):
                    _, file, at, n = lines[k].split("\t")
                    yield file, int(at), int(n)
                    k += 1
            i += 1


def look_up(requests: DataFrame, directory: DataFrame, archive_folder: str, index_folder: str) -> DataFrame:
    """Read the records of distinct capture keys: each request goes to the shards whose key range holds it,
    where the shard's directory is searched; requests in order reuse the block they share."""
    spark = requests.sparkSession
    # One row for each shard, as many as the sort had partitions.
    bounds = sorted((r.first, r.last, r.shard) for r in directory.groupBy("shard").agg(F.min("first").alias("first"), F.max("last").alias("last")).collect())
    sent, shards = spark.sparkContext.broadcast(bounds), max(1, len(bounds))

    def route(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, firsts = arrow_schema("slot int, key string"), [b[0] for b in sent.value]
        for batch in it:
            slots, keys = [], []
            for key in batch.column("key").to_pylist():
                i = bisect.bisect_right(firsts, key) - 1
                while i >= 0 and key <= sent.value[i][1]:
                    slots.append(i)
                    keys.append(key)
                    i -= 1
            yield batches({"slot": slots, "key": keys}, schema)

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, blocks, archive = arrow_schema(FOUND), None, {}, Reader(archive_folder)
        for batch in it:
            rows = {n: [] for n in schema.names}
            for slot, key, *block in zip(*(batch.column(c).to_pylist() for c in ("slot", "key", "first", "last", "file", "at", "n")), strict=True):
                if key is None:
                    blocks.setdefault(slot, []).append(tuple(block))
                    continue
                if held is None or held[0] != slot:
                    held = slot, Directory(blocks.pop(slot, []), index_folder)
                for file, at, n in held[1].find(key):
                    fields, body = parse(zlib.decompress(archive.read(file, at, n), 31))
                    head, _, payload = body.partition(b"\r\n\r\n")
                    revisit = fields["WARC-Type"] == "revisit"
                    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and (len(payload) != size or digest(payload) != stated):
                        raise ValueError(f"a damaged record in {file} at {at}")
                    for c, v in zip(schema.names, (key, fields["WARC-Record-ID"][10:-1], size, stated, fields["WARC-Type"], fields["WARC-Refers-To"][10:-1] if revisit else None), strict=True):
                        rows[c].append(v)
            yield batches(rows, schema)

    slot_of = spark.createDataFrame([(i, b[2]) for i, b in enumerate(bounds)], "slot int, shard string")
    parts = directory.join(F.broadcast(slot_of), "shard").select("slot", F.lit(None).cast("string").alias("key"), "first", "last", "file", "at", "n")
    asked = requests.select("key").distinct().mapInArrow(route, "slot int, key string")
    asked = asked.select("slot", "key", *[F.lit(None).cast(t).alias(c) for c, t in (("first", "string"), ("last", "string"), ("file", "string"), ("at", "long"), ("n", "long"))])
    # A shard's directory rows have no key and sort before its requests.
    return parts.unionByName(asked).repartitionById(shards, "slot").sortWithinPartitions("slot", F.col("key").asc_nulls_first()).mapInArrow(read, FOUND)


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages to archives, index them, and read every capture back through the index:
    (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    bounded_batches(spark)
    archives, index, before = fresh(spark, "warc"), fresh(spark, "cdx"), len(made(spark))
    captures = write_archives(mark_revisits(pages, least_bytes), archives)
    directory = write_index(captures, index)
    found = look_up(captures, directory, archives, index)
    number = lambda c: F.when(F.col(c) != "-", F.col(c)).cast("long")
    found = found.select(number("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
    return settled(found, "read-back", before)
