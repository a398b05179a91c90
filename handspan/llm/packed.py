"""Packed rows: many small records of one task for one part, as a few compressed arrays in a binary column.

A task pre-aggregates what it has read, sorts it by part and gives one row for each part. Spark shuffles
these rows by part number; the receiving task works on whole arrays. Parts are the leading bits of a hash,
so they are even, and their number follows spark.sql.shuffle.partitions and the size of the texts.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard
from pyspark.sql import DataFrame, functions as F

from handspan.llm.text import U64

#: Bytes of text for a part: on average no fewer (so that rows aren't many and tiny) and no more (a task holds a part's arrays).
LEAST_BYTES, MOST_BYTES = 1 << 20, 32 << 20


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes under zstandard; a sorted unsigned 64-bit array is kept as its differences."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        rising = a.dtype == np.uint64 and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        if rising:
            a = np.concatenate([a[:1], np.diff(a)])
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() if len(a) else b""
        z = zstandard.compress(planes, 1)
        out.append(struct.pack("<4s?QQ", a.dtype.str.encode().ljust(4), rising, len(a), len(z)) + z)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(data[0]):
        kind, rising, n, size = struct.unpack_from("<4s?QQ", data, at)
        at += struct.calcsize("<4s?QQ")
        dtype = np.dtype(kind.decode().strip())
        planes = zstandard.decompress(data[at : at + size]) if n else b""
        at += size
        a = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).reshape(n) if n else np.empty(0, dtype)
        out.append(np.cumsum(a, dtype=np.uint64) if rising else a)
    return out


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of each 64-bit hash: equal ranges of its leading 32 bits."""
    return ((h >> U64(32)) * U64(parts)) >> U64(32)


def by_part(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, offsets): a stable order by part, and where each part begins in it."""
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def frees_memory(work):
    """work, after which the worker gives memory that it no longer uses back to the machine; the next task's arrays may be of other sizes."""

    def wrapped(batches):
        try:
            yield from work(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def parts_of(texts: DataFrame, column: str = "_text") -> int:
    """As many parts as the session has shuffle partitions; fewer where a part would get less than LEAST_BYTES of text, more where it would get more than MOST_BYTES."""
    size = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    session = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // MOST_BYTES), min(session, -(-size // LEAST_BYTES)))


def dealt(df: DataFrame, parts: int, column: str = "part") -> DataFrame:
    """The packed rows, each part in a task of its own."""
    return df.repartitionById(parts, F.col(column).cast("int"))
