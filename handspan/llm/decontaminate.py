"""Benchmark decontamination: token windows of documents against a broadcast hash set of benchmark n-grams.

A window is `n` consecutive words of an item, or all words of a shorter item. Documents are scanned
once; every hash hit is verified against the window's words. The set is broadcast only in pieces of a
checked size: a benchmark with more words than `set_words` is cut into several sets by item, and the
documents are scanned with one after the other. After each set but the last the documents and their hits
are written to the shared folder and the broadcast is let go, so no more than two sets are on the driver and
one on a worker, and no item is left out. Each set still passes through the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from handspan.llm.packed import frees_memory
from handspan.llm.shared import carried, dropped, numbered, stored
from handspan.llm.text import LOWER, NOT_ALNUM, U64, _power, blocks, mix, raw, slice_hashes, words

#: Words of benchmark items in one broadcast set (about 50 bytes each).
SET_WORDS = 2_000_000
FILTER_BITS = 20


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of every `size` consecutive word hashes; equal sequences give equal hashes."""
    if len(h) < size:
        return np.empty(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power(len(h)), out=total[1:])
    return mix((total[size:] - total[:-size]) * _power(len(h) + 1, inverse=True)[: len(h) - size + 1])


class GramSet:
    """The windows of some benchmark items by length, in arrays: sorted distinct hashes, the place of each one's words, and its items; a small filter of the hashes; the words to verify with."""

    def __init__(self, items: list[tuple], n: int):
        data, offsets = raw(pa.array([t for _, t in items], pa.string()))
        self.low = LOWER[data]
        start, end, row = words(self.low, offsets, NOT_ALNUM)
        h = slice_hashes(self.low, start, end)
        self.start, self.end = start.astype(np.uint32), end.astype(np.uint32)
        self.names = sorted({str(item) for item, _ in items})
        place = {name: k for k, name in enumerate(self.names)}
        first = np.searchsorted(row, np.arange(len(items) + 1)).tolist()
        found: dict[int, list] = {}
        for (item, _), a, b in zip(items, first[:-1], first[1:], strict=True):
            if size := min(n, b - a):
                x = window_hashes(h[a:b], size)
                found.setdefault(size, []).append((x, np.arange(a, a + len(x), dtype=np.uint32), np.full(len(x), place[str(item)], np.uint32)))
        self.tables, self.filter = {}, {}
        for size, parts in found.items():
            x, at, item = map(np.concatenate, zip(*parts))
            order = np.lexsort((at, item, x))
            x, at, item = x[order], at[order], item[order]
            keep = np.append(True, (x[1:] != x[:-1]) | (item[1:] != item[:-1]))
            x, at, item = x[keep], at[keep], item[keep]
            begin = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            self.tables[size] = (x[begin], at[begin], np.append(begin, len(x)).astype(np.uint32), item)
            self.filter[size] = np.zeros(1 << FILTER_BITS, bool)
            self.filter[size][(x >> U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def hits(self, low: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> list[tuple[int, int, list]]:
        """(first word, words, items) of every verified window in a block."""
        h, out = slice_hashes(low, start, end), []
        for size, (keys, place, begin, item) in self.tables.items():
            x = window_hashes(h, size)
            if not len(x):
                continue
            maybe = np.flatnonzero(self.filter[size][(x >> U64(64 - FILTER_BITS)).astype(np.int64)])
            maybe = maybe[row[maybe] == row[maybe + size - 1]]
            u = np.minimum(np.searchsorted(keys, x[maybe]), len(keys) - 1)
            fit = keys[u] == x[maybe]
            for i, k in zip(maybe[fit].tolist(), u[fit].tolist(), strict=True):
                at = int(place[k])
                if all(low[start[i + j] : end[i + j]].tobytes() == self.low[self.start[at + j] : self.end[at + j]].tobytes() for j in range(size)):
                    out.append((i, size, [self.names[m] for m in item[begin[k] : begin[k + 1]].tolist()]))
        return out


def _sets(benchmark: DataFrame, n: int, item: str, text: str, set_words: int) -> list[GramSet]:
    """The benchmark in sets of about `set_words` words each, read one after the other."""
    b = benchmark.select(benchmark[item].alias("item"), benchmark[text].alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0)) / 2 + 1  # no text has more words than this
    total = b.agg(F.sum(size)).first()[0] or 0
    parts = int(total // set_words) + 1
    for k in range(parts):
        part = b if parts == 1 else b.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        if items := [(r[0], r[1]) for r in part.collect() if r[1]]:
            yield GramSet(items, n)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None, set_words: int = SET_WORDS) -> DataFrame:
    """Adds to each row of docs: n_words, n_hit, items (ids as sorted strings), spans and contaminated.

    n_hit counts the words inside any occurrence of a window; spans are the byte ranges (start, end) of
    maximal runs of such words; contaminated means n_hit > 0 and share * n_hit >= n_words. A null or empty text
    has no words; nulls in other columns stay; repeated rows are judged each; a very long text is scanned whole; an
    empty table gives no rows, an empty benchmark no hits. Items without words match nothing; repeated items count
    once by id. `keep` names the columns of docs to return (default: all); columns that clash with the new names
    are replaced, and any other name may occur.
    """
    new = {"n_words": "long", "n_hit": "long", "items": "array<string>", "spans": "array<struct<start:long,end:long>>", "contaminated": "boolean"}
    spark = docs.sparkSession
    out, final = carried(docs, text, new, keep)
    between = T.StructType([*out.schema.fields, *T._parse_datatype_string("n_words long, ranges array<struct<start:long,end:long>>, items array<string>").fields])
    n_kept = len(out.columns) - 1
    sets = _sets(benchmark, n, item, item_text, set_words)

    def scan(shared, which, last):
        def work(batches):
            grams = shared.value
            for b in batches:
                before_r = b.column("ranges").to_pylist() if which else None
                before_i = b.column("items").to_pylist() if which else None
                counts, ranges, items, spans, hit_words = [], [], [], [], []
                for first, stop, data, offsets in blocks(b, "_text"):
                    low = LOWER[data]
                    start, end, row = words(low, offsets, NOT_ALNUM)
                    rows = stop - first
                    begin = np.searchsorted(row, np.arange(rows + 1))
                    mark = np.zeros(len(start) + 1, np.int64)
                    found: dict[int, set] = {}
                    for at, size, ids in grams.hits(low, start, end, row):
                        mark[at] += 1
                        mark[at + size] -= 1
                        found.setdefault(int(row[at]), set()).update(ids)
                    if which:
                        for r in range(rows):
                            for x in before_r[first + r]:
                                mark[begin[r] + x["start"]] += 1
                                mark[begin[r] + x["end"]] -= 1
                            if before_i[first + r]:
                                found.setdefault(r, set()).update(before_i[first + r])
                    inside = np.cumsum(mark[:-1]) > 0
                    counts += np.diff(begin).tolist()
                    for r in range(rows):
                        if r not in found:
                            ranges.append([]), items.append([]), spans.append([]), hit_words.append(0)
                            continue
                        own = np.flatnonzero(np.diff(np.concatenate([[0], inside[begin[r] : begin[r + 1]].astype(np.int8), [0]])))
                        pairs = own.reshape(-1, 2)
                        ranges.append([{"start": int(a), "end": int(z)} for a, z in pairs])
                        items.append(sorted(found[r]))
                        spans.append([{"start": int(start[begin[r] + a] - offsets[r]), "end": int(end[begin[r] + z - 1] - offsets[r])} for a, z in pairs])
                        hit_words.append(int((pairs[:, 1] - pairs[:, 0]).sum()))
                pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                mine = [b.column(i) for i in range(1, n_kept + 1)]
                if last:
                    flags = [x > 0 and share * x >= w for x, w in zip(hit_words, counts, strict=True)]
                    yield pa.RecordBatch.from_arrays([*mine, pa.array(counts, pa.int64()), pa.array(hit_words, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pair), pa.array(flags, pa.bool_())], names=final.names)
                else:
                    yield pa.RecordBatch.from_arrays([b.column(0), *mine, pa.array(counts, pa.int64()), pa.array(ranges, pair), pa.array(items, pa.list_(pa.string()))], names=between.names)

        return work

    grams, k, held = next(sets, None) or GramSet([], n), 0, None
    while True:
        following = next(sets, None)
        last = following is None
        shared = spark.sparkContext.broadcast(grams)
        out = out.mapInArrow(frees_memory(scan(shared, k, last)), final if last else between)
        if last:
            return out
        if held is not None:
            old, held = held, stored(out, "hits")
            dropped(old)
        else:
            held = stored(out, "hits")
        out = held
        shared.destroy()
        grams, k = following, k + 1


def items_digest(items: str = "items"):
    """Column: lowercase hex sha256 of the item ids, comma-joined in their order as strings."""
    return F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated rows, columns as they were."""
    names = docs.columns
    flagged = contamination(numbered(docs), benchmark, text=f"c_{names.index(options.pop('text', 'text'))}", **options)
    return flagged.where(~F.col("contaminated")).select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(names)])


def cut_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with the hit spans of every text cut out (bytes outside the spans stay as they are)."""
    names = docs.columns
    at = f"c_{names.index(text)}"
    flagged = contamination(numbered(docs), benchmark, text=at, **options)
    raw_text = F.encode(at, "utf-8")
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.octet_length(at).cast("long")))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    parts = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("z")), lambda x: F.decode(F.substring(raw_text, (x["a"] + 1).cast("int"), (x["z"] - x["a"]).cast("int")), "utf-8"))
    cut = F.when(F.size("spans") > 0, F.array_join(parts, "")).otherwise(F.col(at))
    return flagged.select(*[(cut if f"c_{i}" == at else F.col(f"c_{i}")).alias(c) for i, c in enumerate(names)])
