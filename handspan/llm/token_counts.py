"""Token counts at every prefix, by prefix dynamic programming over a published tokenizer.

A text is cut into units over whose borders the tokenizer never joins: for a byte-level BPE with its usual
word pattern, before a run of ASCII white space that follows another character, and between an ASCII letter
and ASCII punctuation. With c(u) the library's count for a unit and P[j] the count of the first j units,

    P[0] = 0,   P[j] = P[j-1] + c(u_j),   count(text[:i]) = P[j-1] + c(u_j[:i - start_j]).

Each worker gives a distinct unit to the library once (units are told apart by 64-bit hashes), so counts are
the library's and most text is never encoded again. Other tokenizers (with normalizers, word ends or
sentencepiece models) take each whole text as one unit, and so does a text that holds a special string.
Inside a unit the library counts each of its prefixes, so the cost of a prefix table grows with the square of
the longest units; total counts need none of it.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from handspan.llm.packed import frees_memory
from handspan.llm.shared import carried
from handspan.llm.text import blocks, slice_hashes

#: Distinct units that a worker remembers (about 60 bytes each); beyond it they are forgotten, which costs time only.
MEMORY_UNITS = 1_500_000
PLAIN_PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
BLOCK_BYTES = 1 << 20
#: Prefixes of units of up to this size are remembered as units are; longer ones are counted and their ids let go.
SHORT_PREFIX = 64
ENCODED_BYTES = 4 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[0x21:0x7F] = True
_PUNCT[0x30:0x3A] = _PUNCT[0x41:0x5B] = _PUNCT[0x61:0x7B] = False
#: Last bytes of white-space characters outside ASCII, and the bytes that stand before those.
_WIDE_LAST = np.zeros(256, bool)
_WIDE_LAST[[0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF, *range(0x80, 0x8B)]] = True
_WIDE_BEFORE = np.zeros(256, bool)
_WIDE_BEFORE[[0xC2, 0x80, 0x81, 0x9A]] = True


class Units:
    """The library's ids of distinct units, kept in arrays; one per worker and tokenizer file."""

    def __init__(self, path: str, limit: int = MEMORY_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.limit, self.marks, self.cut = limit, [], False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            pre = spec.get("pre_tokenizer") or {}
            self.marks = [t["content"].encode() for t in spec.get("added_tokens", [])]
            self.cut = spec.get("normalizer") is None and all(pre.get(k) == v for k, v in PLAIN_PRE_TOKENIZER.items())
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.n, self.start = np.empty(0, np.int32), np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)
        self.used = self.pooled = 0

    def borders(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of every unit of a block; rows never share one."""
        n = len(data)
        first = np.zeros(n, bool)
        if self.cut and n:
            white = _WHITE[data]
            first[1:] = (white[1:] & ~white[:-1]) | (_PUNCT[data[1:]] & _LETTER[data[:-1]])
            wide = _WIDE_LAST[data[1:-1]] & _WIDE_BEFORE[data[:-2]]
            first[2:] &= ~wide
            for mark in self.marks:
                if len(mark) > 1 and n >= len(mark):
                    maybe = np.flatnonzero((data[:-1] == mark[0]) & (data[1:] == mark[1]))
                    for row in np.unique(np.searchsorted(offsets, maybe, "right") - 1):
                        a, z = offsets[row], offsets[row + 1]
                        if mark in data[a:z].tobytes():
                            first[a:z] = False
        at = offsets[:-1]
        first[at[at < n]] = True
        start = np.flatnonzero(first)
        return start, np.append(start[1:], n)

    def look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each unit its index into n, and into start for its ids in the pool."""
        keys, at, code = np.unique(slice_hashes(data, start, end), return_index=True, return_inverse=True)
        if self.used + len(keys) > self.limit:
            self._forget()
        i = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[i] == keys if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        slot = np.empty(len(keys), np.int64)
        if len(self.keys):
            slot[known] = self.slots[i[known]]
        if len(new):
            a, z = start[at[new]], end[at[new]]
            new = np.concatenate([new[order] for order in self._encode_new(data, a, z)])
            slot[new] = np.arange(self.used - len(new), self.used)
            keys_all = np.concatenate([self.keys, keys[new]])
            order = np.argsort(keys_all, kind="stable")
            self.keys, self.slots = keys_all[order], np.concatenate([self.slots, slot[new]])[order]
        return slot[code]

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The token count of each data[start:end], a unit or a prefix of one."""
        out = np.empty(len(start), np.int64)
        short = end - start <= SHORT_PREFIX
        slot = self.look_up(data, start[short], end[short])
        out[short] = self.n[slot]
        long = np.flatnonzero(~short)
        _, at, code = np.unique(slice_hashes(data, start[long], end[long]), return_index=True, return_inverse=True)
        a, z = start[long[at]], end[long[at]]
        n, run = np.empty(len(at), np.int64), np.cumsum(z - a) // ENCODED_BYTES
        for k in np.unique(run):
            i = np.flatnonzero(run == k)
            n[i] = [len(ids) for ids in self.encode([data[x:y].tobytes().decode() for x, y in zip(a[i].tolist(), z[i].tolist(), strict=True)])]
        out[long] = n[code]
        return out

    def _encode_new(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Has units encoded and keeps their ids; gives the order in which they were kept.

        Units that begin with at most one space and hold no other white space are set in lines of one
        text: a line break before them is always a token of its own. Each other unit is a text.
        """
        plain = np.zeros(len(start), bool)
        if self.cut:
            many = np.concatenate([[0], np.cumsum(_WHITE[data])])
            inner = np.minimum(start + 1, end)
            plain = (many[end] == many[inner]) & (_LETTER | _PUNCT)[data[end - 1]] & ((data[start] == 0x20) | ~_WHITE[data[start]])
            plain &= (end - start > 1) | ~_WHITE[data[start]]
        if self.marks:  # a text that holds a special string is a unit; it isn't set in a line
            for i in np.flatnonzero(plain & (end - start >= min(map(len, self.marks)))).tolist():
                if any(m in data[start[i] : end[i]].tobytes() for m in self.marks):
                    plain[i] = False
        lines = np.flatnonzero(plain)
        for k in range(0, len(lines), 50_000):
            part = lines[k : k + 50_000]
            text = b"".join(b"\n" + data[a:z].tobytes() for a, z in zip(start[part].tolist(), end[part].tolist(), strict=True)).decode()
            ids = np.array(self.encode([text])[0], np.uint32)
            breaks = np.flatnonzero(ids == ids[0])
            if len(breaks) == len(part):
                keep = np.ones(len(ids), bool)
                keep[breaks] = False
                self._keep(np.diff(np.append(breaks, len(ids))).astype(np.int32) - 1, ids[keep])
                yield part
            else:
                plain[part] = False
        rest = np.flatnonzero(~plain)
        for k in range(0, len(rest), 20_000):
            part = rest[k : k + 20_000]
            ids = self.encode([data[a:z].tobytes().decode() for a, z in zip(start[part].tolist(), end[part].tolist(), strict=True)])
            self._keep(np.array([len(i) for i in ids], np.int32), np.array([x for i in ids for x in i], np.uint32))
            yield part

    def _keep(self, n: np.ndarray, flat: np.ndarray) -> None:
        self.n = _room(self.n, self.used + len(n))
        self.start = _room(self.start, self.used + len(n))
        self.pool = _room(self.pool, self.pooled + len(flat))
        self.n[self.used : self.used + len(n)] = n
        self.start[self.used : self.used + len(n)] = self.pooled + np.cumsum(n, dtype=np.int64) - n
        self.pool[self.pooled : self.pooled + len(flat)] = flat
        self.used += len(n)
        self.pooled += len(flat)

    def ids(self, slot: np.ndarray) -> np.ndarray:
        """The ids of units one after the other."""
        n = self.n[slot].astype(np.int64)
        total = int(n.sum())
        before = np.cumsum(n) - n
        return self.pool[np.repeat(self.start[slot] - before, n) + np.arange(total)]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.empty(max(n, len(a) * 3 // 2, 1 << 16), a.dtype)
    out[: len(a)] = a
    return out


_units: dict[str, Units] = {}


def units(path: str) -> Units:
    """The worker's own units of a tokenizer; they outlive a task."""
    if path not in _units:
        _units[path] = Units(path)
    return _units[path]


def prefix_counts(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, count, first) of a block of texts: the byte at which each unit ends, the exact token count of its text up
    to there, and where each row's units begin (one entry more than there are rows)."""
    u = units(path)
    start, end = u.borders(data, offsets)
    slot = u.look_up(data, start, end)
    total = np.concatenate([[0], np.cumsum(u.n[slot], dtype=np.int64)])
    first = np.searchsorted(start, offsets)
    row = np.searchsorted(offsets, start, "right") - 1
    return end - offsets[row], total[1:] - total[first[row]], first


def character_counts(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(count, first) of a block of texts: the exact token count of its text up to the end of each character, and where
    each row's characters begin (one entry more than there are rows)."""
    u = units(path)
    start, stop = u.borders(data, offsets)
    begins = (data & 0xC0) != 0x80
    end = np.append(np.flatnonzero(begins)[1:], len(data)) if len(data) else np.empty(0, np.int64)
    unit = np.searchsorted(start, end, "left") - 1  # of the byte before each end
    own = u.counts(data, start[unit], end)
    closes = end == stop[unit]
    total = np.concatenate([[0], np.cumsum(own[closes])])
    row = np.searchsorted(offsets, end, "left") - 1
    return total[unit] - total[np.searchsorted(start, offsets[row])] + own, np.concatenate([[0], np.cumsum(begins)])[offsets]


def prefix_table(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, ends, counts): the offset of each character's end, and the token count of the prefix that ends there.

    With `count_at` and `cut_at` these answer budget and truncation questions without encoding a
    text again. Null or empty text: empty arrays. Repeated keys give repeated rows.
    """
    schema = T.StructType([docs.schema[key], T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))])

    def work(batches):
        for b in batches:
            for row, stop, data, offsets in blocks(b, "_text", BLOCK_BYTES):
                count, first = character_counts(data, offsets, tokenizer)
                ends = [np.arange(1, z - a + 1) for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                counts = [count[a:z] for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, stop - row), pa.array(ends, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], names=[key, "ends", "counts"])

    return docs.select(docs[key].alias("_key"), docs[text].cast("string").alias("_text")).mapInArrow(frees_memory(work), schema)


def count_at(end: str = "at", ends: str = "ends", counts: str = "counts"):
    """Column: tokens of the first `end` characters, or of the whole text where it is shorter (0 for none)."""
    fit = F.size(F.filter(ends, lambda e: e <= F.col(end)))
    return F.when(fit > 0, F.element_at(counts, fit)).otherwise(F.lit(0).cast("long"))


def cut_at(budget: int, ends: str = "ends", counts: str = "counts"):
    """Column: the largest character offset at which a text can be cut so that what is left has at most `budget` tokens."""
    return F.coalesce(F.array_max(F.transform(F.filter(F.arrays_zip(F.col(ends).alias("e"), F.col(counts).alias("c")), lambda z: z["c"] <= budget), lambda z: z["e"])), F.lit(0).cast("long"))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > limit) to the rows of docs, from each text's prefix counts.

    `keep` names the columns of docs to return (default: all); columns with one of the three new names
    are replaced, and any other name may occur. Null and empty texts have 0 bytes and 0 tokens; nulls in other
    columns stay; repeated rows are counted each; an empty table gives no rows; nothing is shuffled. Special
    strings in texts are handled as the library does by default; very long texts are never cut.
    """
    own, schema = carried(docs, text, {"n_bytes": "long", "n_tokens": "long", "over_limit": "boolean"}, keep)

    def work(batches):
        for b in batches:
            size, n = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for start, stop, data, offsets in blocks(b, "_text", BLOCK_BYTES):
                _, count, first = prefix_counts(data, offsets, tokenizer)
                some = first[1:] > first[:-1]
                size[start:stop] = np.diff(offsets)
                n[start:stop][some] = count[first[1:][some] - 1]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(size), pa.array(n), pa.array(n > limit)], names=schema.names)

    return own.mapInArrow(frees_memory(work), schema)
