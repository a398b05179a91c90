"""Interpolated modified Kneser-Ney model of any order from 2, counted in Spark and scored from memory-mapped sorted arrays.

    P_m(w | h) = (a(h w) - D_m(a(h w))) / a(h) + b_m(h) * P_m-1(w | h without its first word)
    P_1(w)     = (n(w) - D_1(n(w))) / n + b_1 / (V + 1)

for m from the order N down to 2, h being the m - 1 words before w. a is the count in training tokens at the top
level and for grams that begin with a text; at lower levels it is the number of different words before the gram.
n(w) is that of one word, n its sum, a(h) the sum over all w, V the different tokens, and D_m three discounts for
each level (for 1, 2 and more) from its counts of counts; b_m(h) and b_1 are the weights the discounts leave. A
context that was never seen leaves all to the next level, as does one that would reach past the text's beginning; a
word that was never seen shares in the last term, so the model is never at a loss. Words are told apart by 64-bit
hashes of their bytes, and so are grams.

Counting: each token is the end of one gram of N words, or of fewer that begin with the text. Each task counts grams
in runs of about CHUNK_TOKENS and sends one packed row (its words once, and their places in that list) to each part;
a part is a range of a hash of the last word but one and four bits of the last, so that a very frequent word is
spread over sixteen, and all grams that share their last two words meet. So each part knows the counts of every level
above one, and writes a sorted array of gram hashes and counts for each. A second exchange adds up each context's count
and its followers by their counts of counts, and for each word its different predecessors. A context of m - 1 words is
itself a gram of level m - 1, so it goes to that gram's part and its values stand beside the gram's, without keys.

The texts are read PASSES times; each pass counts the grams of its own parts only, so what the first exchange holds on
disk at once is that much smaller.

Tables: of a sorted array of 64-bit hashes an index by leading bits and the next 32 bits of each are kept (all bits where
two hashes of a part agree in those), so an unseen gram is taken for a seen one once in some 2 ** 28 lookups. Counts and
contexts are codes into the list of the part's distinct values. Scoring maps these files and does one binary search per
token and level, in the order of the arrays; the place of a token's gram of m - 1 words is the next token's context.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from handspan.llm.packed import by_part, dealt, frees_memory, pack, part_of, parts_of, unpack
from handspan.llm.shared import carried, dropped, file_system, local_path, new_folder, stored
from handspan.llm.text import LOWER, SPACE, U64, blocks, mix, slice_hashes, words

CHUNK_TOKENS = 1_500_000
#: How often the texts are read in training.
PASSES = 2
#: Keys that share an entry of an index, on average.
BUCKET = 16
START, END, NONE = np.uint64(0x51A7B2C90D3E4F61), np.uint64(0xE2D3C4B5A6978879), np.uint64(0)
_K = U64(0x9E3779B97F4A7C15)


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * _K + w)


def pair_part(v: np.ndarray, w: np.ndarray, parts: int) -> np.ndarray:
    return part_of(mix(v + (w & U64(15)) * _K), parts)


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    """One hash of each gram of two or more words, the oldest first; it grows by older words."""
    h = pair_hash(words[-2], words[-1])
    for w in words[-3::-1]:
        h = mix(h * _K + w)
    return h


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, place, row): the words of each text and one end, and each one's place in its text."""
    n = len(offsets) - 1
    low = LOWER[data]
    start, end, row = words(low, offsets, SPACE)
    count = np.bincount(row, minlength=n)
    last = np.cumsum(count + 1) - 1
    token = np.empty(len(start) + n, np.uint64)
    inside = np.ones(len(token), bool)
    inside[last] = False
    token[inside] = slice_hashes(low, start, end)
    token[last] = END
    place = np.arange(len(token)) - np.repeat(last - count, count + 1)
    return token, place, np.repeat(np.arange(n), count + 1)


def back(x: np.ndarray, place: np.ndarray, k: int, start, none) -> np.ndarray:
    """Each token's k-th predecessor: `start` just before the text's first token, `none` beyond."""
    out = np.full_like(x, none)
    out[k:] = x[:-k]
    out[place < k] = none
    out[place == k - 1] = start
    return out


def _counts(token: np.ndarray, place: np.ndarray, parts: int, order: int, passes: int = 1, own: int = 0) -> Iterator[dict]:
    """Packed gram counts of a run of whole texts, one row for each part of this pass (every passes-th, from `own`)."""
    part = pair_part(back(token, place, 1, START, NONE), token, parts)
    mine = np.flatnonzero(part % U64(passes) == own)
    known, code = np.unique(np.append(token, [START, NONE]), return_inverse=True)
    start, none, code = code[-2], code[-1], code[:-2]
    grams = [*(back(code, place, k, start, none)[mine] for k in range(order - 1, 0, -1)), code[mine]]
    whole, limit = grams[-2] * len(known) + grams[-1], len(known) ** 2
    for g in grams[-3::-1]:
        if limit * len(known) >= 1 << 63:
            distinct, whole = np.unique(whole, return_inverse=True)
            limit = len(distinct)
        whole, limit = whole * len(known) + g, limit * len(known)
    _, at, count = np.unique(whole, return_index=True, return_counts=True)
    grams = [g[at] for g in grams]
    by, cut = by_part(part[mine[at]], parts)
    for p in range(own, parts, passes):
        i = by[cut[p] : cut[p + 1]]
        if len(i):
            used, local = np.unique(np.concatenate([g[i] for g in grams]), return_inverse=True)
            local = local.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32).reshape(order, -1)
            yield {"part": p, "data": pack(known[used], count[i].astype(np.uint32), *local)}


def _batch(rows: list[dict], **types) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in types.items()})


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, at): an order that sorts the keys, and where each distinct one begins in it."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    return order, np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)


def _sums(key: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (sorted) and the sums of their values, a column for each."""
    order, at = _grouped(key)
    if not len(at):
        return key, np.zeros((0, len(values)), np.int64)
    return key[order][at], np.column_stack([np.add.reduceat(v[order].astype(np.int64), at) for v in values])


def shortened(keys: np.ndarray, wide: bool = False) -> list[np.ndarray]:
    """[index, rest] of sorted distinct 64-bit keys: where each range of the leading bits begins, and the bits after those."""
    bits = max(0, (len(keys) // BUCKET).bit_length() - 1)
    index = np.searchsorted(keys >> U64(64 - bits) if bits else np.zeros(len(keys), np.uint64), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32)
    rest = keys << U64(bits)
    short = (rest >> U64(32)).astype(np.uint32)
    same = np.flatnonzero(short[1:] == short[:-1]) + 1
    return [index, rest if wide or len(np.setdiff1d(same, index)) else short]


def places(index: np.ndarray, rest: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each key among those that were shortened; -1 for others."""
    if not len(rest):
        return np.full(len(key), -1)
    bits = (len(index) - 1).bit_length() - 1
    at = (key >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    wanted = key << U64(bits)
    if rest.dtype == np.uint32:
        wanted = (wanted >> U64(32)).astype(np.uint32)
    low, end = index[at].astype(np.int64), index[at + 1].astype(np.int64)
    high, last = end.copy(), len(rest) - 1
    for _ in range(int((end - low).max(initial=0)).bit_length()):
        mid = (low + high) >> 1
        less = rest[np.minimum(mid, last)] < wanted
        less &= low < high
        high = np.where(less | (low >= high), high, mid)
        low = np.where(less, mid + 1, low)
    return np.where((low < end) & (rest[np.minimum(low, last)] == wanted), low, -1)


def coded(rows: np.ndarray) -> list[np.ndarray]:
    """[codes, distinct] of a table of numbers: rows equals distinct[codes]."""
    order = np.lexsort(rows.T[::-1])
    new = np.append(True, (rows[order[1:]] != rows[order[:-1]]).any(axis=1)) if len(rows) else np.empty(0, bool)
    codes = np.empty(len(rows), np.int64)
    codes[order] = np.cumsum(new) - 1
    size = int(new.sum())
    return [codes.astype(np.uint8 if size <= 1 << 8 else np.uint16 if size <= 1 << 16 else np.uint32), rows[order[new]].astype(np.int64)]


def _save(folder: str, name: str, arrays: list[np.ndarray]) -> list[str]:
    """Writes arrays as files of their own, and gives each one's name and type; a repeated task writes other files."""
    store, top = file_system(folder)
    store.create_dir(top, recursive=True)
    out = []
    for a in arrays:
        file = f"{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{top}/{file}") as f:
            f.write(np.ascontiguousarray(a))
        out += [file, a.dtype.str]
    return out


class Model:
    """The constants and the files of a trained model; small, whatever the corpus.

    files names, for each table (kind, level) and part, its arrays and their types. Kinds: grams (index, rest, codes and
    values of counts), contexts (codes and values beside the grams of the same level) and words (index, rest, codes, values).
    A context's values are its count and its followers by theirs (1, 2, more); a word's are those, its different
    predecessors, and its count.
    """

    def __init__(self, folder: str, parts: int, order: int, files: dict[tuple[str, int], dict[int, list[str]]], stats: dict[str, object]):
        self.folder, self.parts, self.order, self.files = folder, parts, order, files
        self.__dict__.update(stats)
        self.maps: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"maps": {}}

    def arrays(self, kind: str, level: int, part: int) -> list[np.ndarray] | None:
        """The mapped arrays of a part's table; None where the part has none."""
        files = self.files.get((kind, level), {}).get(part)
        if files is None:
            return None
        for name, dtype in zip(files[::2], files[1::2], strict=True):
            if name not in self.maps:
                path = os.path.join(local_path(self.folder), name)
                self.maps[name] = np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
        return [self.maps[name] for name in files[::2]]

    def _by_part(self, part: np.ndarray, key: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(part, its rows), in order of key within each."""
        order = np.argsort(key) if key is not None else np.arange(len(part))
        order = order[np.argsort(part[order].astype(np.uint16 if self.parts < 1 << 16 else np.uint32), kind="stable")]
        at = np.searchsorted(part[order], np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(at)).tolist():
            yield p, order[at[p] : at[p + 1]]

    def _words(self, word: np.ndarray) -> np.ndarray:
        """The values of each word, zero for unknown ones."""
        out = np.zeros((len(word), 6), np.int64)
        for p, own in self._by_part(part_of(word, self.parts), word):
            if table := self.arrays("words", 1, p):
                index, rest, codes, values = table
                i = places(index, rest, word[own])
                seen = i >= 0
                out[own[seen]] = values.reshape(-1, 6)[codes[i[seen]]]
        return out

    def _grams(self, level: int, part: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in its part's table, count) of each gram; -1 and 0 for unseen ones."""
        at, count = np.full(len(key), -1), np.zeros(len(key), np.int64)
        for p, own in self._by_part(part, key):
            if table := self.arrays("grams", level, p):
                index, rest, codes, values = table
                i = places(index, rest, key[own])
                at[own] = i
                seen = i >= 0
                count[own[seen]] = values[codes[i[seen]]]
        return at, count

    def _contexts(self, level: int, part: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The values, as contexts, of grams by their places; zero where the place is -1."""
        out = np.zeros((len(at), 4), np.int64)
        some = np.flatnonzero(at >= 0)
        for p, own in self._by_part(part[some]):
            if table := self.arrays("contexts", level, p):
                out[some[own]] = table[1].reshape(-1, 4)[table[0][at[some[own]]]]
        return out

    def score(self, token: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count of each token, log10 of its probability after the tokens before it in its text)."""
        known, code = np.unique(np.append(token, START), return_inverse=True)
        w = self._words(known)
        start, t = code[-1], code[:-1]
        different, d = w[:, 4], np.array([0, *self.d[1]])
        p = (self.b_low / (self.V + 1) + (different - d[np.minimum(different, 3)]) / max(self.types, 1) * (different > 0))[t]
        before = [back(token, place, k, START, NONE) for k in range(1, self.order)]  # the nearest first
        part = pair_part(before[0], token, self.parts)
        last = None
        for m in range(2, self.order + 1):
            d = np.array([0, *self.d[m]])
            if m == 2:
                at, context = np.arange(len(token)), w[back(t, place, 1, start, start), :4]
            else:
                at = np.flatnonzero(place >= m - 2)  # a gram that begins with the text is the longest there is
                context = self._contexts(m - 1, part[at - 1], last[at - 1])
            seen = context[:, 0] > 0
            at, context = at[seen], context[seen]
            last = np.full(len(token), -1)
            last[at], c = self._grams(m, part[at], gram_hash([*(x[at] for x in before[m - 2 :: -1]), token[at]]))
            p[at] = (c - d[np.minimum(c, 3)]) / context[:, 0] + (context[:, 1:] * d[1:]).sum(axis=1) / context[:, 0] * p[at]
        return w[t, 5], np.log10(np.maximum(p, 1e-300))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """The three modified discounts from counts of counts, kept between 0 and the count they are taken from."""
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    raw_values = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [float(min(max(d, 0.05), k + 0.95)) for k, d in enumerate(raw_values)]


def train(docs: DataFrame, text: str = "text", order: int = 2, passes: int = PASSES) -> Model:
    """Counts all rows of docs. A null text counts as an empty one (its only token is the end), repeated rows count each time,
    and no column but the text is read. A very long text is counted whole. An empty table gives a model that knows nothing."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    texts = docs.select(docs[text].cast("string").alias("_text"))
    folder, parts = new_folder(spark, "kneser-ney"), parts_of(texts)
    kinds = {"kind": pa.string(), "level": pa.int32(), "part": pa.int32(), "data": pa.binary(), "name": pa.list_(pa.string()), "n": pa.list_(pa.int64())}
    schema = "kind string, level int, part int, data binary, name array<string>, n array<long>"

    def count(own):
        def work(batches):
            held, n = [], 0
            for b in batches:
                for _, _, data, offsets in blocks(b, "_text"):
                    token, place, _ = tokens(data, offsets)
                    held.append((token, place))
                    n += len(token)
                    if n >= CHUNK_TOKENS * passes:
                        for row in _counts(*map(np.concatenate, zip(*held)), parts, order, passes, own):
                            yield _batch([row], part=pa.int32(), data=pa.binary())
                        held, n = [], 0
            if held:
                for row in _counts(*map(np.concatenate, zip(*held)), parts, order, passes, own):
                    yield _batch([row], part=pa.int32(), data=pa.binary())

        return work

    def written(kind, level, part, arrays, n=None):
        return _batch([{"kind": kind, "level": level, "part": part, "data": None, "name": _save(folder, f"{kind}-{level}-{part:05d}", arrays), "n": n}], **kinds)

    def sent(kind, level, part, keys, values):
        o, cut = by_part(part, parts)
        columns = [v.astype(np.uint32 if v.max(initial=0) < 1 << 32 else np.uint64) for v in values.T]
        for p in range(parts):
            i = o[cut[p] : cut[p + 1]]
            if len(i):
                yield _batch([{"kind": kind, "level": level, "part": p, "data": pack(keys[i], *[v[i] for v in columns]), "name": None, "n": None}], **kinds)

    def by_context(m, grams, key, c):
        """What the grams of level m tell of their contexts."""
        o, at = _grouped(key)
        if len(at):
            values = np.column_stack([np.add.reduceat(v[o].astype(np.int64), at) for v in (c, c == 1, c == 2, c > 2)])
            first = o[at]
            part = part_of(key[first], parts) if m == 2 else pair_part(grams[-3][first], grams[-2][first], parts)
            yield from sent("contexts", m, part, key[first], values)

    def merge(batches):
        got, own = [], None
        for b in batches:
            own = b.column(0)[0].as_py() if b.num_rows else own
            for x in b.column(1).to_pylist():
                known, c, *local = unpack(x)
                got.append((c, *[known[i] for i in local]))
        if not got:
            return
        c, *grams = map(np.concatenate, zip(*got))
        del got
        key = gram_hash(grams)
        o, at = _grouped(key)
        key, c, grams = key[o][at], np.add.reduceat(c[o].astype(np.int64), at), [g[o][at] for g in grams]
        word, n = _sums(grams[-1], [c])
        whole = grams[0] != NONE
        short, short_c = [g[~whole] for g in grams], c[~whole]
        key, c, grams = key[whole], c[whole], [g[whole] for g in grams]
        for m in range(order, 1, -1):
            yield written("grams", m, own, [*shortened(key), *coded(c[:, None])], [int((c == k).sum()) for k in (1, 2, 3, 4)])
            yield from by_context(m, grams, grams[0] if m == 2 else gram_hash(grams[:-1]), c)
            if m == 2:
                yield from sent("counts", 1, part_of(word, parts), word, np.column_stack([np.bincount(np.searchsorted(word, grams[1]), minlength=len(word)), n]))
                break
            grams = grams[1:]
            key = gram_hash(grams)
            o, at = _grouped(key)
            first = short[order - m + 1] == START
            grams = [np.concatenate([g[o][at], s[first]]) for g, s in zip(grams, short[order - m + 1 :], strict=True)]
            key, c = np.concatenate([key[o][at], gram_hash([s[first] for s in short[order - m + 1 :]])]), np.concatenate([np.diff(np.append(at, len(o))), short_c[first]])
            o = np.argsort(key)
            key, c, grams = key[o], c[o], [g[o] for g in grams]

    # each pass ends in a table, so the shuffle files of one are gone before the next begins
    merged = [stored(dealt(texts.mapInArrow(frees_memory(count(k)), "part int, data binary"), parts).mapInArrow(frees_memory(merge), schema), "kneser-ney-pass") for k in range(passes)]
    grams = [r for m in merged for r in m.where("kind = 'grams'").select("kind", "level", "part", "name", "n").collect()]  # one row per part and table
    files: dict[tuple[str, int], dict[int, list[str]]] = {}
    for r in grams:
        files.setdefault((r.kind, r.level), {})[r.part] = r.name
    so_far = spark.sparkContext.broadcast(Model(folder, parts, order, files, {}))  # file names

    def add(batches):
        got, own = {}, None
        for b in batches:
            own = b.column(2)[0].as_py() if b.num_rows else own
            for kind, level, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                a = unpack(data)
                value = np.column_stack([x.astype(np.int64) for x in a[1:]])
                if level < 3:  # contexts of one word, and words: one table
                    at = {"contexts": 0, "counts": 4}[kind]
                    value = np.pad(value, ((0, 0), (at, 6 - at - value.shape[1])))
                    level = 1
                got.setdefault(level, []).append((a[0], value))
        for level in list(got):
            key, value = map(np.concatenate, zip(*got.pop(level)))
            o, at = _grouped(key)
            key, value = key[o][at], np.add.reduceat(value[o], at, axis=0)
            if level > 1:
                index, rest, codes, _ = so_far.value.arrays("grams", level - 1, own)
                beside = np.zeros((len(codes), 4), np.int64)
                beside[places(index, rest, key)] = value
                yield written("contexts", level - 1, own, coded(beside))
                continue
            different = value[:, 4]
            stats = [int((value[:, 5] > 0).sum()), int(value[:, 5].sum()), int(different.sum()), *[int((different == k).sum()) for k in (1, 2, 3, 4)], int((different > 2).sum())]
            yield written("words", 1, own, [*shortened(key, wide=True), *coded(value)], stats)

    both = merged[0]
    for m in merged[1:]:
        both = both.unionAll(m)
    # in passes too, so that not all of it is in a shuffle beside the tables that it comes from
    added = [stored(dealt(both.where((F.col("kind") != "grams") & (F.col("part") % passes == k)), parts).mapInArrow(frees_memory(add), schema), "kneser-ney-tables") for k in range(passes)]
    rows = grams + [r for a in added for r in a.select("kind", "level", "part", "name", "n").collect()]  # one row per part and table
    for r in rows:
        files.setdefault((r.kind, r.level), {})[r.part] = r.name
    dropped(*merged, *added)
    total = lambda kind, level, width: np.sum([np.zeros(width, np.int64), *[r.n for r in rows if (r.kind, r.level) == (kind, level)]], axis=0)
    s = total("words", 1, 8)
    d = {1: discounts(*s[3:7].tolist())} | {m: discounts(*total("grams", m, 4).tolist()) for m in range(2, order + 1)}
    b_low = (d[1][0] * s[3] + d[1][1] * s[4] + d[1][2] * s[7]) / s[2] if s[2] else 1.0
    return Model(folder, parts, order, files, {"V": int(s[0]), "N": int(s[1]), "types": int(s[2]), "d": d, "b_low": float(b_low)})


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds to each row: n_tokens, n_known (tokens of the training text), train_tokens, base_score, score, perplexity.

    score is the model's log10 probability of the text and its end; base_score that of single tokens with
    one added to each count; perplexity 10 ** (-score / n_tokens). A null text counts as an empty one; nulls in
    other columns stay; repeated rows are scored each; a very long text is scored whole; an empty table gives no
    rows; columns that clash with the new names are replaced, and any other name may occur.
    """
    new = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double", "perplexity": "double"}
    own, schema = carried(docs, text, new, keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # file names and constants

    def work(batches):
        m = shared.value
        unseen = m.N + (m.V + 1)
        for b in batches:
            n = b.num_rows
            out = np.zeros((4, n))
            for first, stop, data, offsets in blocks(b, "_text", 6 << 20):
                token, place, row = tokens(data, offsets)
                count, log_p = m.score(token, place)
                k = stop - first
                out[0, first:stop] = np.bincount(row, minlength=k)
                out[1, first:stop] = np.bincount(row, count > 0, minlength=k)
                out[2, first:stop] = np.bincount(row, np.log10((count + 1) / unseen), minlength=k)
                out[3, first:stop] = np.bincount(row, log_p, minlength=k)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array(out[0].astype(np.int64)), pa.array(out[1].astype(np.int64)), pa.array(np.full(n, m.N, np.int64)), pa.array(out[2]), pa.array(out[3]), pa.array(10 ** (-out[3] / np.maximum(out[0], 1)))],
                names=schema.names,
            )

    return own.mapInArrow(frees_memory(work), schema)


def held_out(key: str = "doc_id", folds: int = 7, fold: int = 2):
    """Column: whether a row is kept from training, by the crc32 of its id as text (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == fold
