"""Exact-substring dedup: every byte inside a `length`-byte string that also starts in an earlier document.

Which strings repeat is decided by sorted suffixes, built by external induced sorting (induced.py). Spark's
part is to see that equal strings meet in one shard and that only suffixes that can matter are sorted:

1. Pieces. The anchor of a `length`-byte window is its first 16-gram of least hash; a piece is a run of windows
   with one anchor (about 18 windows, 67 bytes). Equal windows have equal anchors, so pieces of different
   anchor grams never share a window. Each task packs its pieces (two hashes, document, place) by anchor.
2. Classes. A part gets all pieces of its anchors. A piece that is equal to one of an earlier document is
   removed whole. The windows of an anchor are of four zones, by how many bytes they have before it (0 to 8, 9 to 17,
   18 to 26, 27 to 34); those of a zone share 42 bytes, told by 16 bits. A zone whose bytes stand in one document only,
   or in equal pieces only, holds nothing that repeats elsewhere. The rest needs sorting. (Fewer bytes or bits would
   be shared by chance, and the more so the larger the table is.)
3. Strings. The texts of those pieces are fetched by document and cut into strings by zone. A class of very many
   pieces is cut finer, by more of the bytes on its outer side, until its strings spread over the shards.
4. Suffixes. Each shard makes strings that are equal as a whole one, leaves out those that are alone in their class,
   and sorts the suffixes of the others; suffixes with a common prefix of `length` bytes are one window, and its
   smallest document keeps it.
5. The removed ranges meet their documents once more, and each text is read through.

Equal strings of one task are sent once, with the places in their smallest document, so a passage that stands in
a third of all documents is a few rows a task. All exchanges are by hash; no group is collected. Removed ranges that
have come to their documents' part go on as one row, so their rows don't add up from exchange to exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from handspan.llm.induced import QUEUE_BYTES, mapped, sorted_buckets
from handspan.llm.packed import by_part, dealt, frees_memory, pack, part_of, parts_of, unpack
from handspan.llm.shared import stored
from handspan.llm.text import _BASE, _BYTE, U64, blocks, mix

GRAM = 16
#: Bytes of text whose pieces are packed together, and of strings that are sent together.
PIECE_BYTES, STRING_BYTES = 32 << 20, 8 << 20
#: Bytes of texts that wait to be packed.
TEXT_BYTES = 16 << 20
#: Bytes and rows that go to or from a worker together.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 256
#: Ranges that wait to be sent to their documents' parts.
RANGES = 1 << 20
WINDOWS = 1 << 16
#: Pieces of a class from which it is cut finer.
LARGE_CLASS = 400
#: Bytes of strings whose suffixes are sorted together.
SORT_BYTES = 3 << 20
#: Strings whose bytes are put in their places together.
STRINGS_AT_ONCE = 1 << 14
_K = U64(0x9E3779B97F4A7C15)
_PLACE = U64((1 << 20) - 1)
_P = {n: U64(pow(int(_BASE), n, 1 << 64)) for n in (1, 2, 4, 8, 16)}


#: Of each piece what the windows of a zone share.
ZONES = ("zone_0", "zone_1", "zone_2", "zone_3")
_KINDS = {"row": np.int32, "start": np.uint32, "windows": np.uint8, "anchor": np.uint8, **dict.fromkeys(ZONES, np.uint16)}


def zones(length: int) -> list[tuple[int, int]]:
    """(fewest, most) bytes before the anchor in the windows of each zone."""
    n = length - GRAM + 1
    half = (n + 1) // 2
    edges = [0, (half + 1) // 2, half, half + (n - half + 1) // 2, n]
    return [(a, z - 1) for a, z in zip(edges[:-1], edges[1:], strict=True)]


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 16 and the 32 bytes from each place on."""
    h = _BYTE[data]
    for n in (1, 2, 4, 8):
        h = h[:-n] * _P[n] + h[n:]
    return mix(h), mix(h[:-16] * _P[16] + h[16:]) if len(h) > 16 else h[:0]


def pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The pieces of a block: row, start (byte in its text), windows, anchor (bytes after start), mark (anchor gram), text (hash of all), and 16 bits each of what the windows of a zone share (0 where it has none)."""
    cols: dict[str, list] = {k: [] for k in ("row", "start", "windows", "anchor", "mark", "text", *ZONES)}
    span = length - GRAM + 1
    sizes = np.diff(offsets)
    for a in range(0, len(data) - length + 1, WINDOWS):
        z = min(a + WINDOWS + length - 1, len(data))
        part = data[a:z]
        m = len(part) - length + 1
        h16, h32 = _grams(part)
        key = (h16 & ~_PLACE) | np.arange(len(h16), dtype=np.uint64)
        least, width = key, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        anchor = (least[:m] & _PLACE).astype(np.int64)
        r0 = int(np.searchsorted(offsets, a, "right") - 1)
        r1 = int(np.searchsorted(offsets, a + m, "left"))
        lo = np.clip(offsets[r0:r1] - a, 0, m)
        hi = np.clip(offsets[r0:r1] + sizes[r0:r1] - length + 1 - a, 0, m)
        fit = np.flatnonzero(hi > lo)
        if not len(fit):
            continue
        lo, n = lo[fit], (hi - lo)[fit]
        at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        row = np.repeat(r0 + fit, n)
        new = np.ones(len(at), bool)
        new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        s = at[first]
        windows = np.diff(np.append(first, len(at)))
        g = anchor[s]
        end = s + windows + length - 1
        mark = h16[g]
        mid = (s + end - 32) // 2
        text = mix(mix(h32[s] * _K + h32[mid]) * _K + h32[end - 32] + (windows * 64 + (g - s)).astype(np.uint64))
        reach = g - s  # the most bytes that a window has before the anchor
        shared = []
        for fewest, most in zones(length):
            has = np.flatnonzero((reach >= fewest) & (reach - (windows - 1) <= most))
            bits = np.zeros(len(s), np.uint64)
            bits[has] = np.maximum(mix(h32[g[has] - fewest] * _K + h32[g[has] + length - most - 32]) >> U64(48), U64(1))
            shared.append(bits)
        for k, v in (("row", row[first]), ("start", s + a - offsets[row[first]]), ("windows", windows), ("anchor", reach), ("mark", mark), ("text", text), *zip(ZONES, shared, strict=True)):
            cols[k].append(v.astype(_KINDS.get(k, np.uint64)))
    return {k: np.concatenate(v) if v else np.empty(0, _KINDS.get(k, np.uint64)) for k, v in cols.items()}


def _together(keys: list[np.ndarray], exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): an order that brings equal tuples of the keys together, by one hash of the tuple, and where a new hash begins in it.

    exact: where a new tuple begins; should two tuples share a hash, the same tuple may begin more than once.
    """
    h = keys[0].astype(np.uint64)
    for k in keys[1:]:
        h = mix(h * _K + k)
    order = np.argsort(h)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in (keys if exact else [h])], axis=0)
    return order, new


def _ranges(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping and adjoining ranges of a document made one."""
    order = np.lexsort((start, tie, doc))
    doc, tie, start, end = doc[order], tie[order], start[order], end[order]
    same = np.zeros(len(doc), bool)
    same[1:] = (doc[1:] == doc[:-1]) & (tie[1:] == tie[:-1])
    group = np.cumsum(~same) - 1
    wide = int(end.max(initial=0)) + 1
    so_far = np.maximum.accumulate(end + group * wide) - group * wide  # groups ascend, so none reaches into the next
    new = ~same
    new[1:] |= start[1:] > so_far[:-1]
    at = np.flatnonzero(new)
    return doc[at], tie[at], start[at], np.maximum.reduceat(end, at) if len(at) else end


def _owner(doc: np.ndarray, tie: np.ndarray, parts: int) -> np.ndarray:
    return part_of(mix(doc.view(np.uint64) + tie * _K), parts)


KINDS = {"part": pa.int32(), "kind": pa.int32(), "data": pa.binary()}
SCHEMA = "part int, kind int, data binary"
GONE, WANTED, PIECES, STRINGS, TEXTS = 0, 1, 2, 3, 4


def _rows(work):
    """work, which gives (part, kind, data), as a task of Spark: its rows go out many together."""

    def wrapped(batches):
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for row in work(batches):
            held.append(row)
            size += len(row[2])
            if size >= BATCH_BYTES // 4 or len(held) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), KINDS.values(), strict=True)], names=list(KINDS))
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), KINDS.values(), strict=True)], names=list(KINDS))

    return frees_memory(wrapped)


def _come(batches):
    """(part, kind, data) of each row that a task gets."""
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


def _by_owner(kind: int, parts: int, doc: np.ndarray, tie: np.ndarray, *arrays: np.ndarray):
    """Rows of a kind for the parts that own the documents, in order of document."""
    order = np.lexsort((arrays[0], tie, doc))
    doc, tie = doc[order], tie[order]
    arrays = tuple(a[order] for a in arrays)
    o, cut = by_part(_owner(doc, tie, parts), parts)
    for p in range(parts):
        i = o[cut[p] : cut[p + 1]]
        if len(i):
            yield p, kind, pack(doc[i], tie[i], *[a[i] for a in arrays])


def _gone(parts: int, doc, tie, start, end):
    if len(doc):
        d, t, s, e = _ranges(doc, tie, start, end)
        yield from _by_owner(GONE, parts, d, t, s.astype(np.uint32), (e - s).astype(np.uint32))


def _joined(rows: list[bytes]) -> list[np.ndarray]:
    """Removed ranges that have come to their documents' part, as one set: document, tie, start, end."""
    m = _merge_docs(rows)
    if not m:
        return []
    start = m[2].astype(np.int64)
    return list(_ranges(m[0], m[1], start, start + m[3]))


def _carried(gone: dict[int, list[bytes]]):
    """Removed ranges that have come to their documents' part, as one row of each part; they leave `gone`."""
    while gone:
        p, rows = gone.popitem()
        d, t, s, e = _joined(rows)
        yield p, GONE, pack(d, t, s.astype(np.uint32), (e - s).astype(np.uint32))


class _Lost:
    """Ranges that a task removes, kept until there are many, so that they are few rows for each part."""

    def __init__(self, parts: int):
        self.parts, self.held, self.n = parts, [], 0

    def add(self, doc: np.ndarray, tie: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Rows for the parts, if there are many."""
        if len(doc):
            self.held.append(_ranges(doc, tie, start, end))
            self.n += len(self.held[-1][0])
        if self.n >= RANGES:
            yield from self.rest()

    def rest(self):
        """Rows for the parts of all that is kept."""
        if self.held:
            yield from _gone(self.parts, *[np.concatenate(a) for a in zip(*self.held, strict=True)])
        self.held, self.n = [], 0


def _documents(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ties, valid): the 64-bit id and the text's hash; rows without an id aren't valid."""
    ids = batch.column(0)
    valid = np.asarray(ids.is_valid())
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), valid


def _pack_texts(docs: DataFrame, parts: int) -> DataFrame:
    """Documents as compressed runs, for the part that owns each."""

    def work(batches):
        held: list[list] = [[] for _ in range(parts)]
        size = [0] * parts
        zip_ = zstandard.ZstdCompressor(level=2)

        def out(p):
            ids, ties, valid, texts = zip(*held[p])
            row = p, TEXTS, pack(np.array(ids, np.int64), np.array(ties, np.uint64), np.array(valid, bool), np.array([len(t) for t in texts], np.int64), np.frombuffer(zip_.compress(b"".join(texts)), np.uint8))
            held[p], size[p] = [], 0
            return row

        total = 0
        for b in batches:
            ids, ties, valid = _documents(b)
            owner = _owner(ids, ties, parts).astype(np.int64).tolist()
            for first, stop, data, offsets in blocks(b, "_text"):
                for i in range(first, stop):
                    t = data[offsets[i - first] : offsets[i - first + 1]].tobytes()
                    p = owner[i]
                    held[p].append((ids[i], ties[i], valid[i], t))
                    size[p] += len(t)
                    total += len(t)
                    if size[p] > 4 << 20:
                        total -= size[p]
                        yield out(p)
                if total > TEXT_BYTES:
                    for p in range(parts):
                        if held[p]:
                            yield out(p)
                    total = 0
        for p in range(parts):
            if held[p]:
                yield out(p)

    return docs.mapInArrow(_rows(work), SCHEMA)


def _texts(data: bytes):
    """(id, tie, valid, text) of each document of a run."""
    ids, ties, valid, sizes, z = unpack(data)
    text = zstandard.decompress(z.tobytes()) if len(z) else b""
    at = 0
    for i, t, v, n in zip(ids.tolist(), ties.tolist(), valid.tolist(), sizes.tolist(), strict=True):
        yield i, t, v, text[at : at + n]
        at += n


def _merge_docs(rows: list[bytes]) -> list[np.ndarray]:
    """Packed rows of one kind as one set of arrays, by document."""
    got = [unpack(x) for x in rows]
    if not got:
        return []
    out = [np.concatenate(a) for a in zip(*got)]
    order = np.lexsort((out[2], out[1], out[0]))
    return [a[order] for a in out]


class _Finder:
    """Looks up a document's rows in merged arrays."""

    def __init__(self, arrays: list[np.ndarray]):
        self.arrays = arrays
        if arrays:
            doc, tie = arrays[0], arrays[1]
            at = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])))
            end = np.append(at[1:], len(doc))
            self.at = {(d, t): (a, z) for d, t, a, z in zip(doc[at].tolist(), tie[at].tolist(), at.tolist(), end.tolist(), strict=True)}
        else:
            self.at = {}

    def of(self, doc: int, tie: int) -> list[np.ndarray]:
        a, z = self.at.get((doc, tie), (0, 0))
        return [x[a:z] for x in self.arrays[2:]] if z else []


def _cuts(length: int) -> list[list[tuple[int, int]]]:
    """For each flag of a piece the (most, fewest) bytes before the anchor in the windows of each string that it is cut into.

    Bits 0 to 3 of a flag: which zones need sorting; 4 to 7: which of them are large. A large one is cut finer, into widths that
    double with the distance from its outer side.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    for zone, (low, top) in enumerate(zones(length)):
        fine, width, n = [], 1, 0
        while n <= top - low:
            width = min(width, top - low + 1 - n)
            fine.append((low + n + width - 1, low + n) if zone < 2 else (top - n, top - n - width + 1))
            n, width = n + width, width * 2
        for flag, cuts in enumerate(out):
            if flag >> zone & 1:
                cuts += fine if flag >> zone & 16 else [(top, low)]
    return out


def _send_strings(parts: int, lost: _Lost, found: list[tuple[bytes, int, int, int, bytes]]):
    """Distinct strings with the places in their smallest document to their shards; other places are removed at once.

    found: (class, document, tie, start, string).
    """
    import xxhash

    groups: dict[tuple[bytes, bytes], list] = {}
    for key, doc, tie, start, text in found:
        groups.setdefault((key, text), []).append((doc, tie, start))
    gone: list[tuple] = []
    rows: dict[int, list] = {}
    for (key, text), places in groups.items():
        least = min(p[0] for p in places)
        own = []
        for p in places:
            if p[0] == least:
                own.append(p)
            else:
                gone.append((*p, len(text)))
        h = xxhash.xxh3_64_intdigest(key)
        rows.setdefault((h >> 32) * parts >> 32, []).append((text, own, h & 0xFFFFFFFF))
    if gone:
        d, t, s, n = zip(*gone)
        start = np.array(s, np.int64)
        yield from lost.add(np.array(d, np.int64), np.array(t, np.uint64), start, start + np.array(n, np.int64))
    for p, strings in rows.items():
        text = b"".join(s[0] for s in strings)
        places = [x for s in strings for x in s[1]]
        yield (
            p, STRINGS,
            pack(
                np.array([len(s[0]) for s in strings], np.uint32), np.array([len(s[1]) for s in strings], np.uint32), np.array([s[2] for s in strings], np.uint32),
                np.array([x[0] for x in places], np.int64), np.array([x[1] for x in places], np.uint64), np.array([x[2] for x in places], np.uint32), np.frombuffer(zstandard.compress(text, 3), np.uint8),
            ),
        )


def sort_shard(texts: list[bytes], docs: np.ndarray, length: int, memory: int = QUEUE_BYTES) -> list[np.ndarray]:
    """For each string the windows (by place) that also stand in a string of a smaller document, by sorted suffixes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    symbols = mapped(int(sizes.sum()) + len(texts) + 1, np.uint16, memory)
    symbols[:-1] = 1
    for a in range(0, len(texts), STRINGS_AT_ONCE):
        own = sizes[a : a + STRINGS_AT_ONCE]
        data = np.frombuffer(b"".join(texts[a : a + STRINGS_AT_ONCE]), np.uint8)
        symbols[np.arange(len(data)) + np.repeat(starts[a] + np.arange(len(own)), own)] = data + np.uint16(2)
    lost = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for suffix, common in sorted_buckets(symbols, length, memory):
        same = common >= length
        several = same.copy()  # a window that neither the one before nor the one after equals stands once
        several[:-1] |= same[1:]
        suffix, group = suffix[several], np.cumsum(~same)[several]
        owner = np.searchsorted(starts, suffix, "right") - 1
        place = suffix - starts[owner]
        window = place + length <= sizes[owner]
        owner, place, group = owner[window], place[window], group[window]
        if not len(group):
            continue
        at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        least = np.minimum.reduceat(docs[owner], at)
        repeated = docs[owner] > np.repeat(least, np.diff(np.append(at, len(group))))
        lost.append((owner[repeated], place[repeated]))
    o, p = map(np.concatenate, zip(*lost))
    order = np.lexsort((p, o))
    o, p = o[order], p[order]
    cut = np.searchsorted(o, np.arange(len(texts) + 1))
    return [p[cut[i] : cut[i + 1]] for i in range(len(texts))]


def repeated_ranges(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """(packed removed ranges for each document's part, number of parts)."""
    if not 48 <= length <= 56:  # so that 32-byte hashes cover a piece, and what is known of its sides
        raise ValueError("strings of 48 to 56 bytes are supported")
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)  # both sides of the pipe to a worker hold a batch
    named = docs.select(docs[key].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))).alias("tie"), docs[text].cast("string").alias("_text"))
    parts = parts_of(named)

    def cut(batches):
        held: list[dict] = []
        size = 0

        def flush():
            c = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            held.clear()
            order, new = _together([c["mark"], c["text"]], exact=True)
            group = np.cumsum(new) - 1
            least = np.minimum.reduceat(c["doc"][order], np.flatnonzero(new)) if len(order) else np.empty(0, np.int64)
            own = c["doc"][order] == least[group] if len(order) else np.empty(0, bool)
            g = order[~own]
            start = c["start"][g].astype(np.int64)
            yield from _gone(parts, c["doc"][g], c["tie"][g], start, start + c["windows"][g] + length - 1)
            keep = np.sort(order[own])
            o, at = by_part(part_of(mix(c["mark"][keep] * _K), parts), parts)  # marks are minima, so their own leading bits are small
            for p in range(parts):
                i = keep[o[at[p] : at[p + 1]]]
                if not len(i):
                    continue
                pair = np.column_stack([c["doc"][i].view(np.uint64), c["tie"][i]])
                start = c["start"][i].astype(np.int64)
                change = np.append(True, (pair[1:] != pair[:-1]).any(axis=1) | (start[1:] < start[:-1]))
                first = np.flatnonzero(change)
                yield (
                    p, PIECES,
                    pack(c["doc"][i[first]], c["tie"][i[first]], np.diff(np.append(first, len(i))).astype(np.uint32), np.where(change, start, np.append(0, start[1:] - start[:-1])).astype(np.uint32),
                         c["windows"][i].astype(np.uint8), c["anchor"][i].astype(np.uint8), *_planes(c["mark"][i]), *_planes(c["text"][i]), *[c[z][i] for z in ZONES]),
                )

        for b in batches:
            ids, ties, valid = _documents(b)
            for first, stop, data, offsets in blocks(b, "_text"):
                c = pieces(data, offsets, length)
                row = c.pop("row") + first
                ok = valid[row]
                held.append({k: v[ok] for k, v in c.items()} | {"doc": ids[row[ok]], "tie": ties[row[ok]]})
                size += len(data)
                if size >= PIECE_BYTES:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def classes(batches):
        got = []
        gone: dict[int, list[bytes]] = {}
        for p, kind, data in _come(batches):
            if kind == GONE:
                gone.setdefault(p, []).append(data)
                continue
            a = unpack(data)
            n = a[2].astype(np.int64)
            step = a[3].astype(np.int64)
            total = np.cumsum(step)
            head = np.cumsum(n) - n
            start = total - np.repeat(total[head] - step[head], n)
            got.append([np.repeat(a[0], n), np.repeat(a[1], n), start.astype(np.uint32), a[4], a[5], _from_planes(*a[6:8]), _from_planes(*a[8:10]), *a[10:14]])
        yield from _carried(gone)
        if not got:
            return
        whole = []
        for k in range(len(got[0])):
            whole.append(np.concatenate([g[k] for g in got]))
            for g in got:
                g[k] = None
        order, new = _together(whole[5:11], exact=True)
        order = order.astype(np.int32)
        doc, tie, start, windows, anchor, mark = (whole.pop(0)[order] for _ in range(6))
        del whole[0]
        group = (np.cumsum(new) - 1).astype(np.int32)
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(doc, first)
        late = doc > least[group]
        yield from _gone(parts, doc[late], tie[late], start[late].astype(np.int64), start[late].astype(np.int64) + windows[late] + length - 1)
        flag = np.zeros(len(first), np.uint8)
        head, mark = order[first], mark[first]
        for zone, bits in enumerate(whole):
            bits = bits[head]
            some = np.flatnonzero(bits)
            o, fresh = _together([mark[some], bits[some]])
            at = np.flatnonzero(fresh)
            if not len(at):
                continue
            size = np.diff(np.append(at, len(o)))
            d = least[some[o]]
            several = (size > 1) & (np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at))
            flag[some[o]] |= np.repeat(np.where(several, np.where(size >= LARGE_CLASS, 17 << zone, 1 << zone), 0).astype(np.uint8), size)
        flag = flag[group]
        want = ~late & (flag > 0)
        yield from _by_owner(WANTED, parts, doc[want], tie[want], start[want], windows[want], anchor[want], flag[want])

    cuts = _cuts(length)

    def fetch(batches):
        wanted: list[bytes] = []
        gone: dict[int, list[bytes]] = {}
        lost = _Lost(parts)
        finder, found, size = None, [], 0
        for p, kind, data in _come(batches):
            if kind == GONE:
                gone.setdefault(p, []).append(data)
                continue
            yield from _carried(gone)
            if kind == WANTED:
                wanted.append(data)
                continue
            if finder is None:
                finder, wanted = _Finder(_merge_docs(wanted)), []
            if not finder.at:
                continue
            for doc, tie, valid, t in _texts(data):
                got = finder.of(doc, tie) if valid else []
                if not got:
                    continue
                for start, n, reach, flag in zip(*[x.tolist() for x in got], strict=True):
                    g = start + reach
                    for m, f in cuts[flag]:
                        most, fewest = min(m, reach), max(f, reach - n + 1)
                        if most < fewest:
                            continue
                        # what all windows of the class hold: f bytes before the anchor, and as many after it as the class's longest leaves
                        key = bytes([m]) + t[g - f : g + length - m]
                        s = t[g - most : g + length - fewest]
                        found.append((key, doc, tie, g - most, s))
                        size += len(s)
                if size >= STRING_BYTES:
                    yield from _send_strings(parts, lost, found)
                    found, size = [], 0
        yield from _carried(gone)
        if found:
            yield from _send_strings(parts, lost, found)
        yield from lost.rest()

    def sort(batches):
        texts, counts, tags, docs_, ties, starts = [], [], [], [], [], []
        gone: dict[int, list[bytes]] = {}
        lost = _Lost(parts)
        for p, kind, data in _come(batches):
            if kind == GONE:
                gone.setdefault(p, []).append(data)
                continue
            n, k, tag, d, t, s, z = unpack(data)
            text = zstandard.decompress(z.tobytes())
            ends = np.cumsum(n, dtype=np.int64)
            texts += [text[e - m : e] for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
            counts.append(k)
            tags.append(tag)
            docs_.append(d)
            ties.append(t)
            starts.append(s)
        yield from _carried(gone)
        if not texts:
            return
        count, doc, tie, start = np.concatenate(counts).astype(np.int64), np.concatenate(docs_), np.concatenate(ties), np.concatenate(starts).astype(np.int64)
        # strings that are equal as a whole become one, with the places in its smallest document
        seen: dict[tuple[int, bytes], int] = {}
        string = np.repeat([seen.setdefault(s, len(seen)) for s in zip(np.concatenate(tags).tolist(), texts, strict=True)], count)
        tag, texts = np.array([s[0] for s in seen], np.uint32), [s[1] for s in seen]
        del seen
        n = np.array([len(s) for s in texts], np.int64)
        least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(least, string, doc)
        late = doc > least[string]
        yield from lost.add(doc[late], tie[late], start[late], start[late] + n[string[late]])
        places = np.flatnonzero(~late)
        places = places[np.argsort(string[places], kind="stable")]
        doc, tie, start = doc[places], tie[places], start[places]
        first = np.searchsorted(string[places], np.arange(len(texts) + 1))
        order = np.argsort(tag, kind="stable")
        new = np.flatnonzero(np.append(True, tag[order[1:]] != tag[order[:-1]]))
        members = np.diff(np.append(new, len(order)))
        order = order[np.repeat(members > 1, members)]  # a string that is alone in its class shares no window
        size = np.cumsum(n[order])
        a = 0
        while a < len(order):  # whole classes, of about SORT_BYTES together
            z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + SORT_BYTES, "right")))
            while z < len(order) and tag[order[z]] == tag[order[z - 1]]:
                z += 1
            own = order[a:z]
            a = z
            got = sort_shard([texts[i] for i in own.tolist()], least[own], length)
            flat = np.concatenate(got)
            string = np.repeat(own, [len(g) for g in got])
            times = first[string + 1] - first[string]  # every place of a string loses the windows that the string loses
            i = np.repeat(np.arange(len(flat)), times)
            which = first[string[i]] + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
            at = start[which] + flat[i]
            yield from lost.add(doc[which], tie[which], at, at + length)
        yield from lost.rest()

    texts = _pack_texts(named, parts)
    cut_up = dealt(named.mapInArrow(_rows(cut), SCHEMA), parts)
    fetched = dealt(cut_up.mapInArrow(_rows(classes), SCHEMA).unionAll(texts), parts).sortWithinPartitions("kind").mapInArrow(_rows(fetch), SCHEMA)
    # a table, so that what was shuffled for it is gone before the texts are dealt again
    ranges = stored(dealt(fetched, parts).mapInArrow(_rows(sort), SCHEMA), "removed-ranges")
    return dealt(ranges.unionAll(texts), parts).sortWithinPartitions("kind"), parts


def _planes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leading 48 bits of a hash."""
    return (h >> U64(32)).astype(np.uint32), ((h >> U64(16)) & U64(0xFFFF)).astype(np.uint16)


def _from_planes(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << U64(16)) | low.astype(np.uint64)


def _finished(ranges: DataFrame, names: str, each) -> DataFrame:
    """Meets the removed ranges with the texts of each part; each(id or None, text, starts, ends) gives a row."""

    def work(batches):
        gone: list[bytes] = []
        finder = None
        for b in batches:
            for kind, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if kind == GONE:
                    gone.append(data)
                    continue
                if finder is None:
                    finder, gone = _Finder(_joined(gone)), []
                rows = []
                for doc, tie, valid, t in _texts(data):
                    got = finder.of(doc, tie) if valid else []
                    s, e = (got[0].tolist(), got[1].tolist()) if got else ([], [])
                    rows.append(each(doc if valid else None, t, s, e))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), types[k]) for k, c in zip(kinds, zip(*rows), strict=True)], names=[n.split()[0] for n in names.split(", ")])

    types = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    kinds = [n.split()[1] for n in names.split(", ")]
    return ranges.mapInArrow(frees_memory(work), names)


def suffix_dedup(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts and ends of the removed byte ranges.

    A byte goes if a `length`-byte string that covers it also starts in a document of a smaller id; strings are
    judged on the texts as they came, and never cross documents. Null and empty texts, and texts shorter than
    `length`, lose nothing. Rows without an id lose nothing and take nothing from others. Rows of one id lose
    nothing to each other.
    """

    def each(doc, t, starts, ends):
        digest, at = hashlib.sha256(), 0
        for s, e in zip(starts, ends, strict=True):
            digest.update(t[at:s])
            at = e
        digest.update(t[at:])
        return doc, len(t), sum(ends) - sum(starts), len(starts), digest.hexdigest(), starts, ends

    ranges, _ = repeated_ranges(docs, length, key, text)
    return _finished(ranges, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>", each)


def kept_texts(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept): the remaining bytes of each text as UTF-8; characters that a cut has split are replaced."""

    def each(doc, t, starts, ends):
        parts, at = [], 0
        for s, e in zip(starts, ends, strict=True):
            parts.append(t[at:s])
            at = e
        return doc, b"".join([*parts, t[at:]]).decode("utf-8", "replace")

    ranges, _ = repeated_ranges(docs, length, key, text)
    return _finished(ranges, "doc_id long, kept string", each)
