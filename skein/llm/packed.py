"""Arrays packed into the binary columns of shuffled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chunks are numbered from (partition << PARTITION_BITS) on.
PARTITION_BITS = 24
U8 = np.dtype("<u8")


def read(blob: bytes | None, kind: np.dtype | str) -> np.ndarray:
    return np.frombuffer(blob or b"", kind)


def planes(keys: np.ndarray) -> np.ndarray:
    """Sorted hashes byte by byte, the highest first: neighbours share those, so they compress."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8).T


def unplaned(blob: bytes | None) -> np.ndarray:
    return np.ascontiguousarray(read(blob, np.dtype(np.uint8)).reshape(8, -1).T).view(">u8").ravel().astype(U8)


def narrow(x: np.ndarray) -> np.ndarray:
    """Numbers in the bytes that the largest needs, behind a mark of their width, byte by byte:
    most are small, so all bytes but the lowest compress to little."""
    most = int(x.max()) if len(x) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    parts = x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return np.concatenate([np.array([width], np.uint8), parts.ravel()])


def wide(blob: bytes) -> np.ndarray:
    parts = np.frombuffer(blob, np.uint8, offset=1).reshape(blob[0], -1)
    return np.ascontiguousarray(parts.T).view(f"<u{blob[0]}").ravel().astype(np.int64)


def by_bucket(bucket: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Places of each bucket's members, in order."""
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")  # small numbers are sorted by digit
    return np.split(order, np.cumsum(np.bincount(bucket, minlength=buckets))[:-1])


def chunk_place(column: str, most: int, tasks: int) -> Column:
    """The task of a chunk, by its running number: partitions hold about as many chunks each, most at most."""
    return F.pmod(F.shiftright(column, PARTITION_BITS) * most + F.col(column).bitwiseAND((1 << PARTITION_BITS) - 1), F.lit(tasks)).cast("int")
