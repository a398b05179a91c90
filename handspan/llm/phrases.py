"""Collocations by SON: shards are mined at a proportionally lowered support, then the union of what they hold is counted exactly.

A phrase is 2 to `longest` words in a row inside a piece of a text; texts, counts and results are apart by lang. Rows are
dealt to SHARDS shards by a hash of their id. A phrase with f >= support in a lang has f_s >= support * w_s / w in one
shard at least, w_s being the shard's bytes of the lang and w those of all: else the shards' counts would add up to less.

1. Bytes by shard and lang give every row its shard's local support (`_with_support`).
2. Every shard is mined completely, in two exchanges: words and pairs, then longer grams whose pairs are all frequent in
   the shard (a gram isn't more frequent than its parts). A shard is many tasks: a task of the exchange has a range of its
   gram hashes, so a shard may be far larger than a task.
3. The union over the shards, without repetition, is the list of candidates.
4. All candidates are counted globally and exactly, with their words (`_counted`); those below the support go.
5. Cuts, scores, containment and the ranks by lang are joins and aggregates of the counted phrases.

Grams are told apart by 64-bit hashes of their words and lang while they are mined and counted; a phrase's words travel
once for a task beside its counts. What each step mined lies in files of sorted hashes in the shared folder, by
shard and range; tasks map these files (a store that can't be mapped is read).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from handspan.llm.packed import by_part, dealt, frees_memory, pack, part_of, parts_of, unpack
from handspan.llm.shared import column, dropped, file_system, new_folder, stored
from handspan.llm.text import LOWER, U64, blocks, mix, slice_hashes, words

SHARDS = 8
#: Words that are counted together before they go to the exchange.
CHUNK_WORDS = 1_000_000
#: Shares of a lang and shard that Spark may broadcast; more are joined as a table.
HELD_SHARES = 100_000
#: Bytes that end a piece, and those that part words.
PIECE = np.zeros(256, bool)
PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = PIECE.copy()
GAP[[0x20, 0x09]] = True
_K = U64(0x9E3779B97F4A7C15)
_PACKED = "part int, lang string, least long, data binary"


class Hashes:
    """Sorted sets of hashes in files, one for each range of the leading bits; mapped when first asked."""

    def __init__(self, folder: str, files: dict[int, str], parts: int):
        self.folder, self.files, self.parts, self.held = folder, files, parts, {}

    def __getstate__(self):
        return self.__dict__ | {"held": {}}

    def _part(self, p: int) -> np.ndarray:
        if p not in self.held:
            store, top = file_system(self.folder)
            path = f"{top}/{self.files[p]}"
            if self.folder.startswith(("file:", "/")) and os.path.exists(path):
                self.held[p] = np.memmap(path, np.uint64, "r") if os.path.getsize(path) else np.empty(0, np.uint64)
            else:
                with store.open_input_stream(path) as f:
                    self.held[p] = np.frombuffer(f.read(), np.uint64)
        return self.held[p]

    def contain(self, sorted_keys: np.ndarray) -> np.ndarray:
        """Which of the sorted hashes are in the set."""
        out = np.zeros(len(sorted_keys), bool)
        cut = np.searchsorted(part_of(sorted_keys, self.parts), np.arange(self.parts + 1))
        for p in self.files:
            keys = sorted_keys[cut[p] : cut[p + 1]]
            own = self._part(p) if len(keys) else ()
            if len(own):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                out[cut[p] : cut[p + 1]] = own[at] == keys
        return out


def _save(folder: str, hashes: np.ndarray) -> str:
    """Writes a file of its own and gives its name; a repeated task writes another."""
    store, top = file_system(folder)
    store.create_dir(top, recursive=True)
    name = uuid.uuid4().hex
    with store.open_output_stream(f"{top}/{name}") as f:
        f.write(np.ascontiguousarray(hashes))
    return name


def _with_support(docs: DataFrame, support: int, key: str, text: str, lang: str) -> DataFrame:
    """(_text, lang, shard, least): each row with the local support of its lang in its shard."""
    rows = docs.select(
        F.coalesce(column(text).cast("string"), F.lit("")).alias("_text"), F.coalesce(column(lang).cast("string"), F.lit("und")).alias("lang"), F.pmod(F.xxhash64(column(key).cast("string")), F.lit(SHARDS)).cast("int").alias("shard")
    )
    held = rows.groupBy("lang", "shard").agg(F.sum(F.octet_length("_text")).alias("bytes"))
    whole = F.sum("bytes").over(Window.partitionBy("lang"))
    # the share is rounded up in whole numbers; a shard without bytes of a lang has no words of it
    least = F.greatest(F.lit(1), F.expr("(cast({0} as decimal(38,0)) * bytes + whole - 1) div greatest(whole, 1)".format(support)))
    shares = stored(held.withColumn("whole", whole).select("lang", "shard", least.cast("long").alias("least")), "phrase-shares")
    small = shares.count() <= HELD_SHARES
    return rows.join(F.broadcast(shares) if small else shares, ["lang", "shard"]).select("_text", "lang", "shard", "least")


class _Chunk:
    """The words of some whole texts: their bytes, hashes, pieces, and a number for the group (lang, shard) of each."""

    def __init__(self, data, start, end, h, piece, group):
        self.data, self.start, self.end, self.piece, self.group = data, start, end, piece, group
        self.first = h

    def grams(self, seed: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, hash, within) for k = 1, 2, ..: hashes of the grams that begin at each word, and which of them lie in a piece."""
        g, n = mix(self.first ^ seed[self.group]), len(self.first)
        within = np.ones(n, bool)
        yield 1, g, within
        for k in range(2, longest + 1):
            g, within = g.copy(), within.copy()
            g[: n - k + 1] = mix(g[: n - k + 1] * _K + self.first[k - 1 :])
            within[max(n - k + 1, 0) :] = False
            within[: n - k + 1] &= self.piece[: n - k + 1] == self.piece[k - 1 :]
            yield k, g, within


def _chunks(batches) -> Iterator[tuple[_Chunk, list[tuple[str, int, int]], np.ndarray]]:
    """(chunk, its groups (lang, shard, least), the hash of each group's lang) of about CHUNK_WORDS words each; a text is never cut."""
    groups: dict[tuple[str, int, int], int] = {}
    held: list[tuple] = []
    n_words = n_bytes = pieces = 0

    def whole():
        joined = [np.concatenate(x) for x in zip(*held, strict=True)]
        names = list(groups)
        seed = np.array([int.from_bytes(_lang_hash(lang), "little") for lang, _, _ in names], np.uint64)
        return _Chunk(*joined), names, seed

    for b in batches:
        lang, shard, least = (b.column(i).to_pylist() for i in (1, 2, 3))
        for i, j, data, offsets in blocks(b, "_text"):
            low = LOWER[data]
            start, end, row = words(low, offsets, GAP)
            if not len(start):
                continue
            code = np.array([groups.setdefault(x, len(groups)) for x in zip(lang[i:j], shard[i:j], least[i:j], strict=True)], np.int32)
            ends = np.cumsum(PIECE[low], dtype=np.int64)[start]
            new = np.append(True, (row[1:] != row[:-1]) | (ends[1:] != ends[:-1]))
            piece = np.cumsum(new) + pieces
            pieces = int(piece[-1])
            held.append((low, start + n_bytes, end + n_bytes, slice_hashes(low, start, end), piece, code[row]))
            n_words += len(start)
            n_bytes += len(low)
            if n_words >= CHUNK_WORDS:
                yield whole()
                groups, held, n_words, n_bytes = {}, [], 0, 0
    if held:
        yield whole()


def _lang_hash(lang: str) -> bytes:
    import hashlib

    return hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    part, lang, least, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(lang, pa.string()), pa.array(least, pa.int64()), pa.array(data, pa.binary())], names=["part", "lang", "least", "data"])


def _mined(rows: DataFrame, parts: int, lengths: range, pairs: list[Hashes] | None) -> DataFrame:
    """(shard, range, data): the grams of these lengths that are frequent in each shard, as packed sorted hashes.

    pairs: each shard's frequent pairs, all of which a longer gram must be made of.
    """

    def count(batches):
        for chunk, groups, seed in _chunks(batches):
            found: list[list[np.ndarray]] = [[] for _ in groups]
            likely = None
            for k, g, within in chunk.grams(seed, lengths[-1]):
                if pairs is not None and k == 2:
                    likely = np.zeros(len(g), bool)
                    for s in {x[1] for x in groups}:
                        own = np.flatnonzero(within & np.isin(chunk.group, [i for i, x in enumerate(groups) if x[1] == s]))
                        keys, back = np.unique(g[own], return_inverse=True)
                        likely[own] = pairs[s].contain(keys)[back]
                    every = likely.copy()
                elif pairs is not None and k > 2:
                    n = len(g) - k + 2
                    every[:n] &= likely[k - 2 :]
                    every[max(n, 0) :] = False
                    within = within & every
                if k in lengths:
                    for i in range(len(groups)):
                        found[i].append(g[within & (chunk.group == i)])
            out = []
            for (lang, shard, least), own in zip(groups, found, strict=True):
                keys, n = np.unique(np.concatenate(own), return_counts=True)
                cut = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
                for p in range(parts):
                    if cut[p] < cut[p + 1]:
                        out.append((shard * parts + p, lang, least, pack(keys[cut[p] : cut[p + 1]], n[cut[p] : cut[p + 1]].astype(np.uint32))))
            yield _rows(out)

    def frequent(batches):
        held: dict[int, dict[tuple[str, int], list]] = {}
        for b in batches:
            for p, lang, least, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(p, {}).setdefault((lang, least), []).append(unpack(data))
        out: dict[str, list] = {"shard": [], "range": [], "data": []}
        for p, by_lang in held.items():
            kept = [keys[n >= least] for (_, least), rows in by_lang.items() for keys, n in [_added(rows)]]
            out["shard"].append(p // parts)
            out["range"].append(p % parts)
            out["data"].append(pack(np.unique(np.concatenate(kept))))
        yield pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int32()), pa.array(out["range"], pa.int32()), pa.array(out["data"], pa.binary())], names=["shard", "range", "data"])

    packed = rows.mapInArrow(frees_memory(count), _PACKED)
    return stored(dealt(packed, SHARDS * parts).mapInArrow(frees_memory(frequent), "shard int, range int, data binary"), "phrases-mined")


def _added(rows: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct sorted keys, their summed counts) of packed [keys, counts, ..]."""
    keys, n = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def _sets(mined: DataFrame, folder: str, parts: int, by_shard: bool) -> list[Hashes]:
    """The mined hashes as files: one set for each shard, or the union of the shards as the only one. The driver sees file names only."""
    slot = F.col("shard") * parts + F.col("range") if by_shard else F.col("range")

    def write(batches):
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(p, []).append(unpack(data)[0])
        for p, arrays in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([_save(folder, np.unique(np.concatenate(arrays)))])], names=["part", "file"])

    rows = mined.select(slot.cast("int").alias("part"), "data")
    files = {r["part"]: r["file"] for r in dealt(rows, parts * (SHARDS if by_shard else 1)).mapInArrow(frees_memory(write), "part int, file string").collect()}
    return [Hashes(folder, {p: files[s * parts + p] for p in range(parts) if s * parts + p in files}, parts) for s in range(SHARDS if by_shard else 1)]


def _counted(rows: DataFrame, parts: int, candidates: Hashes, longest: int, support: int) -> DataFrame:
    """(lang, phrase, words, f) of all candidates with f >= support, and a row (lang, null, 0, words of the lang) for each lang."""

    def count(batches):
        told: dict[str, np.ndarray] = {}  # whose words this task has sent
        for chunk, groups, seed in _chunks(batches):
            out, code = [], {}
            by_lang = np.array([code.setdefault(x[0], len(code)) for x in groups])
            of = by_lang[chunk.group]
            found: list[list[tuple]] = [[] for _ in code]
            before = None
            for k, g, within in chunk.grams(seed, longest):
                own = np.flatnonzero(within if before is None else within & before)
                keys, first, back, n = np.unique(g[own], return_index=True, return_inverse=True, return_counts=True)
                hit = candidates.contain(keys)
                first = own[first]
                for i in range(len(code)):
                    mine = hit & (of[first] == i)
                    found[i].append((keys[mine], n[mine], np.full(mine.sum(), k), first[mine]))
                yes = np.zeros(len(g), bool)
                yes[own] = hit[back]
                before = yes.copy()
                before[:-1] &= yes[1:]  # a longer gram's first and last parts are candidates
                before[-1:] = False
            for lang, i in code.items():
                keys, n, k, first = (np.concatenate(x) for x in zip(*found[i], strict=True))
                new = ~np.isin(keys, told.get(lang, ()))
                told[lang] = np.union1d(told.get(lang, np.empty(0, np.uint64)), keys[new])
                text = [b" ".join(chunk.data[s:e].tobytes() for s, e in zip(chunk.start[at : at + m], chunk.end[at : at + m], strict=True)) if is_new else b"" for at, m, is_new in zip(first.tolist(), k.tolist(), new.tolist(), strict=True)]
                order, cut = by_part(part_of(keys, parts).astype(np.int64), parts)
                n_words = int((of == i).sum())
                for p in range(parts):
                    own = order[cut[p] : cut[p + 1]]
                    if len(own) or not p:
                        blob = b"".join(text[x] for x in own.tolist())
                        size = np.array([len(text[x]) for x in own.tolist()], np.uint32)
                        out.append((p, lang, n_words * (p == 0), pack(keys[own], n[own].astype(np.int64), k[own].astype(np.uint8), size, np.frombuffer(blob, np.uint8))))
            yield _rows(out)

    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])

    def add(batches):
        held: dict[int, dict[str, list]] = {}
        n_words: dict[str, int] = {}
        for b in batches:
            for p, lang, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(p, {}).setdefault(lang, []).append(unpack(data))
                n_words[lang] = n_words.get(lang, 0) + (0 if p else n)
        for p, by_lang in held.items():
            if not p:
                names = sorted(by_lang)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.nulls(len(names), pa.string()), pa.array([0] * len(names), pa.int32()), pa.array([n_words[x] for x in names], pa.int64())], schema=schema)
            for lang, rows in by_lang.items():
                keys, f = _added(rows)
                frequent = keys[f >= support]
                phrase: dict[int, tuple[str, int]] = {}
                for key, _, k, size, blob in rows:
                    end = np.cumsum(size.astype(np.int64))
                    some = np.flatnonzero((size > 0) & np.isin(key, frequent))
                    for x, a, z, m in zip(key[some].tolist(), (end - size)[some].tolist(), end[some].tolist(), k[some].tolist(), strict=True):
                        if x not in phrase:
                            phrase[x] = (blob[a:z].tobytes().decode("utf-8", "replace"), m)
                got = [phrase[x] for x in frequent.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got), pa.string()), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.int32()), pa.array(f[f >= support])], schema=schema)

    packed = rows.mapInArrow(frees_memory(count), _PACKED)
    return stored(dealt(packed, parts).mapInArrow(frees_memory(add), "lang string, phrase string, words int, f long"), "phrases-counted")


def _ranked(counted: DataFrame, contained: int, best: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): scores of the lowest cut, without phrases that a longer one holds as often."""
    n = counted.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    known = counted.where("words > 0").select("lang", "phrase", "words", "f")
    c = known.where("words > 1").withColumn("w", F.split("phrase", " "))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    longer = c.where("words > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase"), "f")
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    kept = c.join(longer, ["lang", "phrase"], "left").where(F.expr(f"held is null or 100 * cast(held as decimal(38,0)) < {contained} * cast(f as decimal(38,0))"))
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    f = lambda name, value: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    cuts = cuts.join(f("head", "l"), ["lang", "head"]).join(f("tail", "r"), ["lang", "tail"]).join(n, "lang")
    cuts = cuts.withColumns({"_above": F.expr("cast(a as decimal(19,0)) * cast(n as decimal(19,0))").cast("decimal(35,0)"), "_below": (F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)")).cast("decimal(38,0)")})
    cuts = cuts.withColumn("score", F.expr("(_above * cast(1000 as decimal(4,0))) div _below"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = lowest.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= best)
    return top.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, support: int = 100, longest: int = 5, best: int = 2000, contained: int = 100, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's best phrases.

    A-Z are lower-cased; pieces end at `.,;:!?` and at line ends (0x0A to 0x0D), words are parted by blanks and tabs. n is the
    words of the lang, a, l and r the occurrences of the phrase, of its part before the cut and of the rest; the score is
    floor(1000 a n / (l r)) at its lowest cut (the first of ties). A phrase goes if a longer one that holds it has
    `contained` percent of its occurrences. Ranks go by score, then a, both falling, then the phrase's UTF-8 bytes.

    A null text is an empty one, and has no words; a null lang is `und`, with those that are named so. Null ids
    are a shard's rows like others, repeated rows count each time, and very long texts are counted whole. An empty
    table, or one without frequent phrases, gives no rows. Only the three named columns are read, so others may have any names.
    """
    rows = _with_support(docs, support, key, text, lang)
    parts = max(1, -(-parts_of(rows) // SHARDS))
    folder = new_folder(docs.sparkSession, "phrases")
    short = _mined(rows, parts, range(1, 3), None)
    pairs = _sets(short, folder, parts, True)
    long = _mined(rows, parts, range(3, longest + 1), pairs) if longest > 2 else None
    merged = short.unionByName(long) if long is not None else short
    candidates = _sets(merged, folder, parts, False)[0]
    counted = _counted(rows, parts * SHARDS, candidates, longest, support)
    dropped(short, *([long] if long is not None else []))
    return _ranked(counted, contained, best)
