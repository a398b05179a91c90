"""Vectorised helpers over Arrow string columns: byte blocks, word boundaries and 64-bit hashes.

Inside Spark tasks texts stay in Arrow's UTF-8 buffers; numpy works on whole blocks of rows, so no
Python string is made per document. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 1 << 20

#: Bytes that part words in the white-space rule `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that part words in the benchmark rule: all of ASCII but digits and letters.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x41:0x5B] = NOT_ALNUM[0x61:0x7B] = False
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads 64-bit values."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def _power(n: int, inverse: bool = False) -> np.ndarray:
    key = "i" if inverse else "p"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 4096)
        steps = np.full(size, _INVERSE if inverse else _BASE, np.uint64)
        steps[0] = 1
        have = _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets has one more entry than the column has rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) and not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def blocks(batch: pa.RecordBatch, name: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes; a longer text is a run of its own."""
    data, offsets = raw(batch.column(batch.schema.get_field_index(name)))
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word; `parts` marks the separating bytes. Words never cross rows."""
    inside = ~parts[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        at = offsets[:-1]
        at = at[at < len(data)]
        first[at] = inside[at]
        at = offsets[1:]
        at = at[at > 0] - 1
        last[at] = inside[at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, row


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]: equal bytes give equal hashes wherever they stand."""
    if not len(start):
        return np.empty(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(len(data)), out=total[1:])
    return mix((total[end] - total[start]) * _power(len(data) + 1, inverse=True)[start])


def joined(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of each tuple of hashes, order included."""
    out = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        out = mix(out * U64(0x9E3779B97F4A7C15) + h)
    return out


def runs(row: np.ndarray, n_rows: int) -> np.ndarray:
    """Where each row's words begin: n_rows + 1 offsets into the word arrays."""
    return np.searchsorted(row, np.arange(n_rows + 1))


def row_sets(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, by row, then value. Rows must not decrease."""
    if not len(values):
        return values, row
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[keep], row[keep]


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct shingles of `size` white-space words of each row, A-Z lower-cased.

    A row of fewer words has its whole sequence as one shingle; a row without words has none.
    """
    n = len(offsets) - 1
    low = LOWER[data]
    start, end, row = words(low, offsets, SPACE)
    h = slice_hashes(low, start, end)
    out, of = np.empty(0, np.uint64), np.empty(0, np.int64)
    m = len(h) - size + 1
    if m > 0:
        whole = row[:m] == row[size - 1 :]
        at = np.flatnonzero(whole)
        out = joined([h[at + k] for k in range(size)])
        of = row[at]
    first = runs(row, n)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for k in range(1, size):
            which = count[short] == k
            if which.any():
                at = first[short[which]]
                extra[which] = joined([np.full(which.sum(), k, np.uint64), *[h[at + j] for j in range(k)]])
        out, of = np.concatenate([out, extra]), np.concatenate([of, short])
    return row_sets(out, of)
