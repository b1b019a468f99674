"""Media columns: Netpbm and BMP images held in binary columns.

Images are decoded to numpy arrays, resized by area with integral images, cut
into NPY tiles and summarised by difference hashes. An image is reduced to a width of
TILE samples, its height in proportion, and every TILE rows of that are a tile, the last one
with fewer rows; a thumbnail of TILE by TILE samples stands for the whole. The media column is
written to the shared folder and read back, and so are the tiles. Everything happens within a
row, so no shuffle is needed and a lost task is simply run again.

Edge cases: a null text is an empty payload, which is padded to one row of
zeros; equal texts give equal bytes and features; other columns of the input
are not read. Images of any height are integrated in strips of rows, so a very
long text needs memory in proportion to its bytes only.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import arrow_schema, batches, bounded_batches, stash, texts

WIDTH = 64
STRIP = 4096
TILE = 16


def to_pgm(samples: np.ndarray) -> bytes:
    """Binary greyscale Netpbm (P5)."""
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.astype(np.uint8, copy=False).tobytes()


def to_ppm(samples: np.ndarray) -> bytes:
    """Binary colour Netpbm (P6) from an (h, w, 3) array."""
    h, w, _ = samples.shape
    return b"P6\n%d %d\n255\n" % (w, h) + samples.astype(np.uint8, copy=False).tobytes()


def to_bmp(samples: np.ndarray) -> bytes:
    """Uncompressed BMP: 8-bit grey palette for (h, w), 24-bit for (h, w, 3); rows from the bottom."""
    h, w = samples.shape[:2]
    colour = samples.ndim == 3
    row = samples[..., ::-1].reshape(h, w * 3) if colour else samples
    pad = -row.shape[1] % 4
    body = np.pad(row, ((0, 0), (0, pad)))[::-1].astype(np.uint8).tobytes()
    palette = b"" if colour else np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1).__mul__(np.array([1, 1, 1, 0], np.uint8)).tobytes()
    at = 14 + 40 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", at + len(body), 0, 0, at)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24 if colour else 8, 0, len(body), 2835, 2835, 0 if colour else 256, 0)
    return head + info + palette + body


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """The next numbers of a Netpbm header, and where its samples start."""
    at, found = 2, []
    while len(found) < count:
        c = data[at : at + 1]
        if c == b"#":
            at = data.index(b"\n", at) + 1
        elif c.isspace():
            at += 1
        elif c.isdigit():
            end = at
            while data[end : end + 1].isdigit():
                end += 1
            found.append(int(data[at:end]))
            at = end
        else:
            raise ValueError("not a Netpbm header")
    return found, at + 1


def from_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (h, w) or (h, w, 3); uint8, or uint16 where the maximum is above 255."""
    kind = data[:2]
    if kind in (b"P1", b"P4"):
        (w, h), at = _header(data, 2)
        if kind == b"P1":
            bits = np.frombuffer(bytes(c for c in data[at - 1 :] if c in b"01"), np.uint8)[: w * h] - 48
            return (1 - bits.reshape(h, w)).astype(np.uint8) * 255
        rows = np.frombuffer(data, np.uint8, (w + 7) // 8 * h, at).reshape(h, -1)
        return (1 - np.unpackbits(rows, axis=1)[:, :w]) * np.uint8(255)
    if kind not in (b"P2", b"P3", b"P5", b"P6"):
        raise ValueError("not a Netpbm file")
    (w, h, most), at = _header(data, 3)
    shape = (h, w, 3) if kind in (b"P3", b"P6") else (h, w)
    n = int(np.prod(shape))
    if kind in (b"P2", b"P3"):
        return np.array(data[at - 1 :].split()[:n], dtype=np.int64).astype(np.uint16 if most > 255 else np.uint8).reshape(shape)
    return np.frombuffer(data, ">u2" if most > 255 else np.uint8, n, at).reshape(shape)


def from_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-, 24- and 32-bit BMP, either row order; a grey palette gives (h, w)."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    at = struct.unpack_from("<I", data, 10)[0]
    size, w, h, _, depth, packing = struct.unpack_from("<IiiHHI", data, 14)
    if packing != 0 or depth not in (8, 24, 32):
        raise ValueError(f"unsupported BMP: {depth} bits, compression {packing}")
    stride = (w * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), at).reshape(abs(h), stride)[:, : w * depth // 8]
    rows = rows[::-1] if h > 0 else rows
    if depth == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(used, 4)[:, 2::-1]
        out = palette[rows]
        return out[..., 0] if (palette == palette[:, :1]).all() else out
    return rows.reshape(abs(h), w, depth // 8)[..., 2::-1]


def decode(data: bytes) -> np.ndarray:
    return from_bmp(data) if data[:2] == b"BM" else from_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    """One channel: the image itself, or the rounded mean of its channels."""
    return image if image.ndim == 2 else image.mean(axis=2).round().astype(image.dtype)


def integral_at(image: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of the integral image: sums over all samples above each row and left of each column."""
    h, w = image.shape
    out, base = np.zeros((len(rows), w + 1)), np.zeros(w, np.int64)
    for top in range(0, h, STRIP):
        part = np.cumsum(image[top : top + STRIP], axis=0, dtype=np.int64)
        part += base
        inside = (rows > top) & (rows <= top + len(part))
        out[inside, 1:] = np.cumsum(part[rows[inside] - top - 1], axis=1)
        base = part[-1]
    return out


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area under each target sample, edges weighted by their share."""
    h, w = image.shape
    ys, xs = np.arange(height + 1) * h / height, np.arange(width + 1) * w / width
    y0, x0 = np.minimum(ys.astype(np.int64), h - 1), np.minimum(xs.astype(np.int64), w - 1)
    low, high = integral_at(image, y0), integral_at(image, y0 + 1)
    rows = low + (high - low) * (ys - y0)[:, None]
    at = rows[:, x0] + (rows[:, x0 + 1] - rows[:, x0]) * (xs - x0)
    return np.diff(np.diff(at, axis=0), axis=1) / ((h / height) * (w / width))


def difference_hash(image: np.ndarray, size: int = 8) -> str:
    """A bit for each sample of the reduced image that is darker than its right neighbour, as hex."""
    small = np.round(area_resize(grey(image), size, size + 1), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(samples: np.ndarray) -> bytes:
    """The bytes of an NPY file of rounded samples."""
    out = io.BytesIO()
    np.save(out, np.clip(np.round(samples), 0, 255).astype(np.uint8))
    return out.getvalue()


def npy_tile(image: np.ndarray, size: int = TILE) -> bytes:
    """The image reduced to size x size, as the bytes of an NPY file."""
    return npy(area_resize(grey(image), size, size))


def npy_tiles(image: np.ndarray, size: int = TILE) -> list[bytes]:
    """The image reduced to a width of size, cut into tiles of size rows from the top, as NPY files."""
    h, w = image.shape[:2]
    small = area_resize(grey(image), max(1, round(h * size / w)), size)
    return [npy(small[top : top + size]) for top in range(0, len(small), size)]


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8, zeros appended up to a positive multiple of the width; and the length before."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0"), len(raw)


def store(texts_df: DataFrame, key: str = "doc_id", text: str = "text", fmt: str = "pgm") -> DataFrame:
    """Texts as images in a binary column: (key, n_bytes, media)."""
    bounded_batches(texts_df.sparkSession)
    write = {"pgm": to_pgm, "bmp": to_bmp}[fmt]
    ddl = "row_key long, n_bytes long, media binary"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for batch in it:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                padded = [payload_of(x) for x in texts(part, "row_text")]
                yield batches({"row_key": part.column("row_key"), "n_bytes": [n for _, n in padded], "media": [write(np.frombuffer(p, np.uint8).reshape(-1, WIDTH)) for p, _ in padded]}, schema)

    return texts_df.select(F.col(key).cast("long").alias("row_key"), F.col(text).alias("row_text")).mapInArrow(run, ddl)


READ_BACK = "row_key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary, tiles array<binary>"


def read_back(media_df: DataFrame) -> DataFrame:
    """Decode stored images: digests of the samples and of the file, the hash, the thumbnail and the NPY tiles."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(READ_BACK.rpartition(",")[0]).append(pa.field("tiles", pa.list_(pa.binary())))
        for batch in it:
            rows = {n: [] for n in schema.names}
            for key, n, media in zip(*(batch.column(c).to_pylist() for c in ("row_key", "n_bytes", "media")), strict=True):
                image = decode(media)
                payload = image.tobytes()
                for c, v in zip(schema.names, (key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), npy_tile(image), npy_tiles(image)), strict=True):
                    rows[c].append(v)
            yield batches(rows, schema)

    return media_df.select("row_key", "n_bytes", "media").mapInArrow(run, READ_BACK)


def media_features(docs: DataFrame) -> DataFrame:
    """The contract's digest of every document: text to PGM, written and read back, and its tiles likewise."""
    tiled = stash(read_back(stash(store(docs), "media")), "tiles")
    digests = F.size("tiles").cast("long").alias("n_tiles"), F.sha2(F.array_join(F.transform("tiles", lambda x: F.sha2(x, 256)), " "), 256).alias("tiles_sha256")
    return tiled.select(F.col("row_key").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.sha2("tile", 256).alias("tile_sha256"), *digests)
