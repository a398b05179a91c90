"""Jaccard join of shingle sets by T-occurrence search, exact.

Two documents are linked where 100 * |both| >= percent * |either|. Every link lies in one family, and a family's
members are searched through inverted lists:

1. Documents of equal sets collapse to the smallest id.
2. Families. A linked pair of sizes a <= b differs in at most (a + b)(100 - percent) / (100 + percent) shingles. Sets are
   in classes by size; a class has room for `differ` differences, and cuts all shingles into differ + 1 + SPARE parts by
   hash. A linked pair has more than SPARE parts alike, so it shares a hash of a whole part. (Parts of fewer than LEAST
   shingles say little: where at most SPARE of a set's parts are that small they are left out; one that both have is
   small for both, so one of the others is alike.) No threshold is estimated, so no link is lost. Documents that
   share a part's hash are joined in families by connected components.
3. In a family, for a query of n shingles a link must hold T = ceil(percent * n / 100) of them. DivideSkip (`Lists.search`):
   the L longest of the query's lists are set aside, the others are merged by a heap, and what occurs T - L times is
   looked up in the long lists by binary search. Members of the largest component need no query, as every link between
   components has an end outside of it, and hits inside the query's own component aren't looked up.
4. A family beyond BLOCK_ROWS members or BLOCK_SHINGLES shingles is spread. Each member is compared with one pivot, the
   member of most shared parts, in tasks of SALT_ROWS; there it becomes its difference from the pivot, a small set. Those
   that aren't linked with the pivot search the family's blocks, one task for two blocks, by T-occurrence on differences:
   |x ^ y| = |dx| + |dy| - 2 |dx & dy|. If all are linked with the pivot there is nothing to search.

Tasks give links or components only, never the pairs they have looked at.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from handspan.llm.components import connected_components
from handspan.llm.packed import frees_memory
from handspan.llm.shared import column, dropped, stored
from handspan.llm.text import U64, blocks, mix, shingles

#: Members and shingles of a family that one task searches; larger ones are spread.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 2_000_000
#: Members that are compared with the pivot in one task.
SALT_ROWS = 256
#: Size classes grow by this much, in hundredths.
GROWTH = 130
#: A part of fewer shingles is small.
LEAST = 2
#: Parts that a task groups at once before it sends them on.
GROUPED_PARTS = 3_000_000
#: What a lookup in a long list costs against a step of the merge; the method's paper calls it mu.
LOOKUP = 0.01
_P, _S, _C = U64(0x6A09E667F3BCC909), U64(0xBB67AE8584CAA73B), U64(0x3C6EF372FE94F82B)
_K = U64(0x9E3779B97F4A7C15)


def classes(most: int) -> list[int]:
    """The least size of each class, up to one beyond `most`."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(-(-edges[-1] * GROWTH // 100) if edges[-1] > 3 else edges[-1] + 1)
    return edges


def differ(edges: np.ndarray, percent: int) -> np.ndarray:
    """The most shingles in which a linked pair differs whose larger set is in each class."""
    return 2 * (edges[1:] - 1) * (100 - percent) // (100 + percent)


def spare(k: np.ndarray) -> np.ndarray:
    return 2 + k // 50


def part_hashes(sets: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the parts of each row's set (sets[first[i]:first[i + 1]]), by row; sets that can only be linked with equal ones have none."""
    count = np.diff(first)
    edges = np.array(classes(int(count.max(initial=0)) * 100 // percent + 1), np.int64)
    room = differ(edges, percent)
    own = np.searchsorted(edges, count, "right") - 1
    up = np.flatnonzero((count > 0) & (count * 100 // percent >= edges[np.minimum(own + 1, len(edges) - 1)]))  # may be the smaller set of a pair whose larger is a class higher
    rows = np.flatnonzero(count)
    of, cls = np.concatenate([rows, up]), np.concatenate([own[rows], own[up] + 1])
    some = room[cls] > 0
    of, cls = of[some], cls[some]
    if not len(of):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    order = np.argsort(of, kind="stable")
    of, cls = of[order], cls[order]
    extra = spare(room[cls])
    parts = room[cls] + 1 + extra
    offset = np.cumsum(parts) - parts
    size = count[of]
    at = np.repeat(first[of] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    h = sets[at]
    which = ((mix(h ^ _P) >> U64(32)) * np.repeat(parts.astype(np.uint64), size)) >> U64(32)
    slot = which.astype(np.int64) + np.repeat(offset, size)
    total = np.zeros(int(parts.sum()), np.uint64)
    np.add.at(total, slot, mix(h ^ _S))
    held = np.bincount(slot, minlength=len(total))
    small = held < LEAST
    n_small = np.add.reduceat(small.astype(np.int64), offset)
    keep = ~small | np.repeat(n_small > extra, parts)
    number = np.arange(len(total)) - np.repeat(offset, parts)
    seed = mix((np.repeat(cls, parts).astype(np.uint64) << U64(40)) + number.astype(np.uint64) + _C)
    return mix(total * _K + seed)[keep], np.repeat(of, parts)[keep]


def set_parts(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, parts) of each row of docs (doc_id, _text); s1 and s2 are two hashes of the whole set."""

    def work(batches):
        for b in batches:
            n = b.num_rows
            count, s1, s2, n_parts = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
            found: list[np.ndarray] = [np.empty(0, np.int64)]
            for start, stop, data, offsets in blocks(b, "_text"):
                sets, row = shingles(data, offsets, size)
                first = np.searchsorted(row, np.arange(stop - start + 1))
                some = np.flatnonzero(np.diff(first))
                if not len(some):
                    continue
                count[start:stop] = np.diff(first)
                s1[start + some] = np.add.reduceat(mix(sets), first[some])
                s2[start + some] = np.add.reduceat(mix(sets ^ U64(0x5BF03635DCF5A1E7)), first[some])
                h, of = part_hashes(sets, first, percent)
                found.append(h.view(np.int64))
                n_parts[start:stop] = np.bincount(of, minlength=stop - start)
            offsets = np.append(0, np.cumsum(n_parts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(count), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))],
                names=["doc_id", "n_shingles", "s1", "s2", "parts"],
            )

    return docs.mapInArrow(frees_memory(work), "doc_id long, n_shingles long, s1 long, s2 long, parts array<long>")


def _stars(part: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, its smallest document) of each part; (smallest document, document) of each member of a part that several documents have."""
    order = np.lexsort((doc, part))
    part, doc = part[order], doc[order]
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
    count = np.diff(np.append(at, len(part)))
    lead = np.repeat(doc[at], count)
    several = np.repeat(count > 1, count)
    return part[at], doc[at], lead[several], doc[several]


def shared_parts(reps: DataFrame) -> DataFrame:
    """(lead, doc_id, n): for every document that has a part in common with others a smallest document of such, and how many parts they share.

    reps: doc_id, parts. A task joins what it holds itself, so of a part that very many documents have each task sends on one row.
    """
    names = ["part", "lead", "doc_id", "n"]

    def counted(lead, doc):
        if not len(lead):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        pair = np.unique(np.column_stack([lead, doc]), axis=0, return_counts=True)
        return pair[0][:, 0], pair[0][:, 1], pair[1]

    def batch(part, lead, doc, n):
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(lead, pa.int64()), pa.array(doc, pa.int64()), pa.array(n, pa.int64())], names=names)

    def local(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def grouped():
            part, lead, star, doc = _stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield batch(part, lead, lead, np.zeros(len(part), np.int64))
            yield batch(pa.nulls(len((c := counted(star, doc))[0]), pa.int64()), *c)

        for b in batches:
            size = b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            held.append((b.column(1).flatten().to_numpy(zero_copy_only=False), np.repeat(b.column(0).to_numpy(zero_copy_only=False), size)))
            if sum(len(x[0]) for x in held) >= GROUPED_PARTS:
                yield from grouped()
                held.clear()
        if held:
            yield from grouped()

    def across(batches):
        part, lead = np.empty(0, np.int64), np.empty(0, np.int64)

        def grouped(part, lead):
            _, _, star, doc = _stars(part, lead)
            return batch(pa.nulls(len((c := counted(star, doc))[0]), pa.int64()), *c)

        for b in batches:
            done = b.filter(b.column(0).is_null())
            if done.num_rows:
                yield done
            b = b.filter(b.column(0).is_valid())
            part, lead = np.append(part, b.column(0).to_numpy()), np.append(lead, b.column(1).to_numpy())
            if len(part) >= GROUPED_PARTS:
                cut = int(np.searchsorted(part, part[-1]))  # rows come in order of their parts; the last part may go on
                yield grouped(part[:cut], lead[:cut])
                part, lead = part[cut:], lead[cut:]
        yield grouped(part, lead)

    kind = "part long, lead long, doc_id long, n long"
    sent = reps.select("doc_id", "parts").mapInArrow(frees_memory(local), kind)
    dealt = sent.repartition(F.coalesce("part", "lead")).sortWithinPartitions("part", "lead")
    return dealt.mapInArrow(frees_memory(across), kind).groupBy("lead", "doc_id").agg(F.sum("n").alias("n"))


class Lists:
    """Inverted lists of some sets: for each value the places of the sets that hold it, rising."""

    def __init__(self, sets: list[np.ndarray]):
        value = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(value, kind="stable")
        self.owner, value = owner[order], value[order]
        self.start = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.empty(0, np.int64)
        self.value, self.end = value[self.start], np.append(self.start[1:], len(value))

    def of(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) in owner of the query's lists, the shortest first; values that no set holds have none."""
        at = np.minimum(np.searchsorted(self.value, query), max(len(self.value) - 1, 0))
        at = at[self.value[at] == query] if len(self.value) else at[:0]
        at = at[np.argsort(self.end[at] - self.start[at], kind="stable")]
        return self.start[at], self.end[at]

    def search(self, query: np.ndarray, least: int, wanted=None) -> tuple[np.ndarray, np.ndarray]:
        """(places, occurrences) of the sets that hold `least` (1 or more) of the query's values; wanted(places) tells which are looked up at all."""
        begin, end = self.of(query)
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(begin) < least:
            return none
        longest = int(end[-1] - begin[-1])
        n_long = min(least - 1, int(least / (LOOKUP * np.log2(longest) + 1)), len(begin))
        n_short = len(begin) - n_long
        merged = heapq.merge(*[self.owner[b:e].tolist() for b, e in zip(begin[:n_short].tolist(), end[:n_short].tolist(), strict=True)])
        found = [(x, n) for x, run in groupby(merged) if (n := sum(1 for _ in run)) >= least - n_long]
        if not found:
            return none
        place, count = (np.array(c, np.int64) for c in zip(*found, strict=True))
        if wanted is not None:
            keep = wanted(place)
            place, count = place[keep], count[keep]
        for left, (b, e) in enumerate(zip(begin[n_short:].tolist(), end[n_short:].tolist(), strict=True)):
            if not len(place):
                return none
            own = self.owner[b:e]
            at = np.minimum(np.searchsorted(own, place), len(own) - 1)
            count += own[at] == place
            keep = count + (n_long - left - 1) >= least
            if not keep.all():
                place, count = place[keep], count[keep]
        return place, count


class _Union:
    """Components of places 0..n-1, each named by one of its members."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: int, others: np.ndarray) -> None:
        names = np.unique(self.of[np.append(others, a)])
        if len(names) > 1:
            self.of[np.isin(self.of, names)] = names[0]


def linked_components(sets: list[np.ndarray], ids: np.ndarray, percent: int) -> np.ndarray:
    """The component of each set of a family, by its smallest id; sets of one id are one."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    groups = _Union(n)
    for x in np.flatnonzero(np.diff(np.sort(ids)) == 0):
        same = np.flatnonzero(ids == np.sort(ids)[x])
        groups.join(int(same[0]), same)
    lists = Lists(sets)
    shared = np.array([int((e - b).sum()) for b, e in map(lists.of, sets)])
    asked = np.zeros(n, bool)
    order = np.argsort(-shared, kind="stable")  # the most central first: its answer joins most
    for x in order.tolist():
        names, count = np.unique(groups.of, return_counts=True)
        if len(names) == 1:
            break
        if asked.any() and groups.of[x] == names[np.argmax(count)]:
            continue
        own = groups.of[x]
        place, both = lists.search(sets[x], -(-percent * int(size[x]) // 100), lambda p, own=own: groups.of[p] != own)
        groups.join(x, place[both * 100 >= (size[x] + size[place] - both) * percent])
        asked[x] = True
    out = np.empty(n, np.int64)
    for name in np.unique(groups.of):
        own = groups.of == name
        out[own] = ids[own].min()
    return out


def _sets_of(batch, size: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for start, stop, data, offsets in blocks(batch):
        sets, row = shingles(data, offsets, size)
        first = np.searchsorted(row, np.arange(stop - start + 1))
        out += [sets[a:z].copy() for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return out


def _small(members: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): each member of the families (family, doc_id, text) with the smallest id of its component."""

    def work(batches):
        family, ids, sets = None, [], []

        def done():
            comp = linked_components(sets, np.array(ids), percent)
            return pa.RecordBatch.from_pydict({"a": pa.array(comp), "b": pa.array(ids, pa.int64())})

        for b in batches:
            for name, i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _sets_of(b, size), strict=True):
                if name != family and ids:
                    yield done()
                    ids, sets = [], []
                family = name
                ids.append(i)
                sets.append(s)
        if ids:
            yield done()

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # searching costs more than its bytes tell, so tasks aren't merged by bytes
    dealt = members.select("family", "doc_id", "text").repartition(n, "family").sortWithinPartitions("family", "doc_id")
    return dealt.mapInArrow(frees_memory(work), "a long, b long")


def _against_pivot(members: DataFrame, docs: DataFrame, pivots: DataFrame, size: int, percent: int) -> DataFrame:
    """(family, doc_id, pivot, n, n_pivot, apart, linked): what each member of the large families differs in from its family's pivot."""
    dealt = members.join(pivots, "family").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    wanted = dealt.select("family", "salt", F.lit(1).alias("role"), "doc_id")
    heads = pivots.select("family", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("pivot").alias("doc_id"))
    texts = wanted.union(heads).join(docs, "doc_id").select("family", "salt", "role", "doc_id", "text")

    def work(batches):
        held, pivot, lead = None, np.empty(0, np.uint64), None
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("family", "doc_id", "pivot", "n", "n_pivot", "apart", "linked")}
            for family, salt, role, i, s in zip(*(b.column(k).to_pylist() for k in range(4)), _sets_of(b, size), strict=True):
                if not role:
                    if held != (family, salt):
                        held, pivot, lead = (family, salt), s, i
                    continue
                apart = np.setxor1d(s, pivot, assume_unique=True)
                both = (len(s) + len(pivot) - len(apart)) // 2
                for k, v in zip(out, (family, i, lead, len(s), len(pivot), apart.tobytes(), both * 100 >= (len(s) + len(pivot) - both) * percent), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "apart" else pa.bool_() if k == "linked" else pa.int64()) for k, v in out.items()})

    rows = texts.repartition("family", "salt").sortWithinPartitions("family", "salt", "role", "doc_id")
    return rows.mapInArrow(frees_memory(work), "family long, doc_id long, pivot long, n long, n_pivot long, apart binary, linked boolean")


def _among_rest(apart: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of members that aren't linked with their pivot, with each other or with others of the family.

    The rest asks: its blocks meet all blocks of the family, each two in a task.
    """
    sized = apart.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum(F.length("apart") / 8) / BLOCK_SHINGLES)).cast("int").alias("n_blocks"), F.count(F.when(~F.col("linked"), 1)).alias("rest"))
    sized = stored(sized.where("rest > 0"), "family-blocks")
    m = apart.join(sized, "family").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("n_blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    asking = m.where("not linked").select("family", F.col("block").alias("i"), F.explode(every).alias("j"), F.lit(True).alias("asks"), "doc_id", "n", "apart")
    asked = m.select("family", F.explode(every).alias("i"), F.col("block").alias("j"), F.lit(False).alias("asks"), "doc_id", "n", "apart")

    def work(key, table):
        table = table.combine_chunks()
        asks, ids, n = table.column("asks").to_numpy(), table.column("doc_id").to_numpy(), table.column("n").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("apart").to_pylist()]
        size = np.array([len(s) for s in sets], np.int64)
        theirs = np.flatnonzero(~asks)
        lists = Lists([sets[i] for i in theirs.tolist()])
        a, b = [], []
        for x in np.flatnonzero(asks).tolist():
            room = (n[x] + n[theirs]) * (100 - percent) // (100 + percent)
            common = np.maximum(-(-(size[x] + size[theirs] - room) // 2), 0)  # of the differences, for a link
            least = int(common.min(initial=1 << 62))
            if least > size[x]:
                continue
            if least > 0:
                place, both = lists.search(sets[x], least)
            else:  # so near to the pivot that nothing in common is needed
                begin, end = lists.of(sets[x])
                both = np.bincount(np.concatenate([lists.owner[s:e] for s, e in zip(begin, end, strict=True)] or [np.empty(0, np.int64)]), minlength=len(theirs))
                place = np.arange(len(theirs))
            far = size[x] + size[theirs[place]] - 2 * both
            total = n[x] + n[theirs[place]]
            hit = (total - far) * 100 >= (total + far) * percent
            hit = theirs[place[hit]]
            a += [ids[x]] * len(hit)
            b += ids[hit].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return asking.union(asked).groupBy("family", "i", "j").applyInArrow(work, "a long, b long").where("a != b"), sized


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs; component_id is the smallest id reachable by links.

    Null and empty texts, and texts without words, have empty sets and are linked with nothing; a shorter text has its
    whole word sequence as one shingle. Rows of equal sets are linked. A row without an id is linked with nothing: its
    component is null. Repeated rows are all returned; rows of one id are one document that has all their links. Very
    long texts are compared whole; an empty table gives no rows; other columns of docs are not read, so their names may
    be any. Ids are whole numbers; an id that is none fails the job.
    """
    used: list[DataFrame] = []

    def kept(df, name):
        used.append(stored(df, name))
        return used[-1]

    named = docs.select(column(key).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    sig = stored(set_parts(named.select("doc_id", F.col("text").alias("_text")), size, percent), "set-parts")
    some = sig.where("n_shingles > 0 and doc_id is not null")
    members = kept(shared_parts(some.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.first("parts").alias("parts"))), "part-members")
    reps = kept(some.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n")), "distinct-sets")
    once = named.where("doc_id is not null")
    families = connected_components(members.select(F.col("lead").alias("a"), F.col("doc_id").alias("b")))
    used.append(families)
    # rows of one id may have several sets: they are one document, and a family of their own where they share no part
    several = reps.groupBy("doc_id").agg(F.count("*").alias("sets"), F.sum("n").alias("n"))
    of = several.join(families.select(F.col("node").alias("doc_id"), F.col("component").alias("family")), "doc_id")
    of = kept(of, "family-members")
    large = of.groupBy("family").agg(F.sum("sets").alias("rows"), F.sum("n").alias("n")).where(f"rows > {BLOCK_ROWS} or n > {BLOCK_SHINGLES}")
    large = kept(large.select("family", F.ceil(F.col("rows") / SALT_ROWS).cast("int").alias("salts")), "large-families")
    any_large = not large.isEmpty()
    texts = kept(of.select("doc_id", "family").join(once.hint("merge"), "doc_id").select("family", "doc_id", "text"), "family-texts")  # one join of the texts, at every size
    little = texts.join(large, "family", "left_anti") if any_large else texts
    links = [kept(_small(little, size, percent), "family-links")]
    if any_large:
        wide = kept(of.join(large, "family").select("family", "doc_id", "salts"), "large-family-members")
        worth = members.groupBy("doc_id").agg(F.sum("n").alias("worth"))
        pivots = wide.join(worth, "doc_id").groupBy("family").agg(F.max_by("doc_id", F.struct("worth", -F.col("doc_id"))).alias("pivot"), F.max("salts").alias("salts"))
        pivots = kept(pivots, "family-pivots")
        apart = kept(_against_pivot(wide.select("family", "doc_id"), texts.select("doc_id", "text"), pivots, size, percent), "apart-from-pivot")
        links.append(apart.where("linked").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")))
        rest, blocks_of = _among_rest(apart, percent)
        used.append(blocks_of)
        links.append(kept(rest, "links-of-the-rest"))
    joined = links[0]
    for x in links[1:]:
        joined = joined.union(x)
    found = connected_components(joined) if any_large else None
    if found is not None:
        used.append(found)
        component = found.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    else:
        component = joined.select(F.col("b").alias("doc_id"), F.col("a").alias("component_id")).distinct()
    final = reps.select("s1", "s2", "doc_id").join(component, "doc_id", "left")
    final = stored(final.select("s1", "s2", F.coalesce("component_id", "doc_id").alias("component_id")), "set-components")
    dropped(*used)
    own = lambda c: F.when(F.col("n_shingles") > 0, F.col(c)).alias(c)
    out = sig.where("doc_id is not null").select("doc_id", "n_shingles", own("s1"), own("s2")).join(final, ["s1", "s2"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.union(sig.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))
