"""Near-duplicate documents by MinHash: banded minima, signature and full-set verification, components.

A document's set holds the distinct shingles of `size` lower-cased white-space words; documents are linked
where 100 * |intersection| >= percent * |union|. The way to the links:

1. Documents of equal sets collapse to the smallest id.
2. Universal hash minima, in BANDS bands of a few rows each, make a signature; documents that agree in a band
   share a bucket. A pair at the threshold s misses every bucket with probability (1 - s**rows)**BANDS; there are
   as many rows, up to five, as keep that below MISS.
3. In each bucket all members are checked against one centre, the member that shares most buckets (of a
   group of edited copies that is the original). Full sets are compared, from whole texts.
4. Components of the links found. A bucket is finished if its members are in one component, or if the rest
   is too far away: 1 - similarity is a metric, so a document that is further than twice the allowed distance
   from the centre can't be linked with a member that is linked with the centre.
5. Members of unfinished buckets are compared among each other in blocks, across components only: by signature,
   and on full sets where that may be similar enough. The tasks give links, and components are built again.

No bucket is capped and no group is expanded into all pairs: a group of copies costs one check per member.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from handspan.llm.components import connected_components
from handspan.llm.packed import frees_memory
from handspan.llm.shared import dropped, stored
from handspan.llm.text import U64, blocks, mix, shingles

BANDS, MOST_ROWS, MISS = 28, 5, 1e-6
#: Members checked against one centre in a task.
SALT_ROWS = 256
#: Members of unfinished buckets in one block.
BLOCK_ROWS = 512
#: A pair whose signatures agree in so many standard deviations less than the threshold isn't checked on full sets.
DEVIATIONS = 5

_rng = np.random.default_rng(99)
_A = _rng.integers(0, 1 << 63, BANDS * MOST_ROWS, dtype=np.uint64) * U64(2) + U64(1)
_B = _rng.integers(0, 1 << 63, BANDS * MOST_ROWS, dtype=np.uint64)


def band_rows(percent: int) -> int:
    """Minima in a band for a threshold."""
    return max([1, *(r for r in range(1, MOST_ROWS + 1) if (1 - (percent / 100) ** r) ** BANDS <= MISS)])


def minima(sets: np.ndarray, row: np.ndarray, n_rows: int, n_minima: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a set, their minima as a table of unsigned 32-bit values)."""
    first = np.searchsorted(row, np.arange(n_rows))
    count = np.diff(np.append(first, len(row)))
    some = np.flatnonzero(count)
    out = np.empty((len(some), n_minima), np.uint32)
    if len(some):
        at, held = first[some], np.empty(len(sets), np.uint64)
        for k in range(n_minima):
            np.multiply(sets, _A[k], out=held)
            np.add(held, _B[k], out=held)
            out[:, k] = np.minimum.reduceat(held, at) >> U64(32)
    return some, out


def signatures(docs: DataFrame, size: int, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, s1, s2, bands, signature) of each row; s1 and s2 are two hashes of the whole set."""

    def work(batches):
        for b in batches:
            n = b.num_rows
            count = np.zeros(n, np.int64)
            s1, s2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            bands: list = [None] * n
            signature: list = [None] * n
            for start, stop, data, offsets in blocks(b, "_text"):
                sets, row = shingles(data, offsets, size)
                some, table = minima(sets, row, stop - start, BANDS * rows)
                if not len(some):
                    continue
                first = np.searchsorted(row, some)
                count[start + some] = np.diff(np.append(first, len(row)))
                s1[start + some] = np.add.reduceat(mix(sets), first)
                s2[start + some] = np.add.reduceat(mix(sets ^ U64(0x5BF03635DCF5A1E7)), first)
                wide = table.astype(np.uint64).reshape(len(some), BANDS, rows)
                h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(some), BANDS))
                for k in range(rows):
                    h = mix(h * U64(0x9E3779B97F4A7C15) + wide[:, :, k])
                low = table.astype("<u2")
                for i, r in enumerate(some.tolist()):
                    bands[start + r] = h[i].view(np.int64)
                    signature[start + r] = low[i].tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(count), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(signature, pa.binary())],
                names=["doc_id", "n_shingles", "s1", "s2", "bands", "signature"],
            )

    return docs.select(docs[key].alias("doc_id"), docs[text].alias("_text")).mapInArrow(frees_memory(work), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, signature binary")


def similarities(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(centre, doc_id, both, either): intersection and union sizes of the full sets of each pair.

    The texts come from one join with docs (doc_id, text). A centre with many partners is dealt to as many
    tasks as they need, each with the centre's text once.
    """
    salts = pairs.groupBy("centre").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    salts = stored(salts, "centres")
    salt = F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")
    wanted = pairs.join(salts, "centre").select("centre", salt.alias("salt"), F.lit(1).alias("role"), F.col("doc_id"))
    centres = salts.select("centre", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("centre").alias("doc_id"))
    texts = wanted.union(centres).join(docs, "doc_id").select("centre", "salt", "role", "doc_id", "text")

    def work(batches):
        held, against = None, np.empty(0, np.uint64)
        for b in batches:
            key = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            role, ids = b.column(2).to_pylist(), b.column(3).to_pylist()
            out: dict[str, list] = {"centre": [], "doc_id": [], "both": [], "either": []}
            for start, stop, data, offsets in blocks(b):
                sets, row = shingles(data, offsets, size)
                first = np.searchsorted(row, np.arange(stop - start + 1))
                for i in range(start, stop):
                    own = sets[first[i - start] : first[i - start + 1]]
                    if not role[i]:
                        held, against = key[i], own.copy()
                    elif held == key[i] and len(against):
                        at = np.minimum(np.searchsorted(against, own), len(against) - 1)
                        both = int((against[at] == own).sum())
                        out["centre"].append(key[i][0])
                        out["doc_id"].append(ids[i])
                        out["both"].append(both)
                        out["either"].append(len(own) + len(against) - both)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    dealt = texts.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "role")
    return dealt.mapInArrow(frees_memory(work), "centre long, doc_id long, both long, either long")


def _unfinished(members: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): the links across components among the members of unfinished buckets.

    members: cluster, doc_id, component, signature; a cluster holds the documents of unfinished buckets whose centres
    are in one component. It is cut into blocks by a hash, and each pair of blocks is one task's group, so a large cluster is many tasks of
    bounded size. A task looks at signatures first, and compares full sets where these agree enough; it gives links
    only, never the pairs that it has looked at.
    """
    sizes = stored(members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("n_blocks")), "cluster-sizes")
    m = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("n_blocks")).cast("int"))
    m = m.join(docs, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    m = m.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "component", "signature", "text")
    n, p = BANDS * band_rows(percent), percent / 100
    least = n * p - DEVIATIONS * (n * p * (1 - p)) ** 0.5

    def work(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        table = table.combine_chunks()
        block = table.column("block").to_numpy()
        ids, comp = table.column("doc_id").to_numpy(), table.column("component").to_numpy()
        sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u2").reshape(len(ids), -1)
        sets: list[np.ndarray] = []
        for batch in table.select(["text"]).to_batches():
            for start, stop, data, offsets in blocks(batch):
                h, row = shingles(data, offsets, size)
                first = np.searchsorted(row, np.arange(stop - start + 1))
                sets += [h[x:z] for x, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        count = np.array([len(x) for x in sets], np.int64)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out_a, out_b = [], []
        for x in left.tolist():
            near = right[(comp[right] != comp[x]) & (np.minimum(count[right], count[x]) * 100 >= np.maximum(count[right], count[x]) * percent)]
            if i == j:
                near = near[ids[near] > ids[x]]
            if len(near):
                near = near[(sig[near] == sig[x]).sum(axis=1) >= least]
            if not len(near):
                continue
            theirs = np.concatenate([sets[y] for y in near.tolist()])
            at = np.minimum(np.searchsorted(sets[x], theirs), count[x] - 1)
            starts = np.cumsum(count[near]) - count[near]
            both = np.add.reduceat((sets[x][at] == theirs).astype(np.int64), starts)
            hit = near[both * 100 >= (count[near] + count[x] - both) * percent]
            out_a += [ids[x]] * len(hit)
            out_b += ids[hit].tolist()
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return m.groupBy("cluster", "i", "j").applyInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest id reachable over links), kept (doc_id = component_id).

    Null and empty texts, and texts without words, have empty sets and are linked with nothing; a shorter
    text has its whole word sequence as one shingle. Rows with equal sets are linked. A row without an id
    is linked with nothing: its component is null and it is kept. Repeated rows are all returned; rows of one id
    are one document that has all their links. Very long texts are compared whole; an empty table gives no rows;
    other columns of docs are not read, so their names may be any. Ids are whole numbers; an id that is none fails the job.
    """
    used: list[DataFrame] = []

    def kept(df, name):
        used.append(stored(df, name))
        return used[-1]

    named = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    sig = stored(signatures(named, size, band_rows(percent)), "signatures")
    some = sig.where("n_shingles > 0 and doc_id is not null")
    reps = kept(some.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("bands", "signature"), "doc_id").alias("x")).select("s1", "s2", "doc_id", "x.*"), "distinct-sets")
    rows = reps.select("doc_id", F.explode("bands").alias("bucket"))
    full = kept(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    rows = kept(rows.join(full, "bucket"), "bucket-members")
    shared = rows.groupBy("doc_id").agg(F.sum("n").alias("shared"))
    centre = rows.join(shared, "doc_id").groupBy("bucket").agg(F.max_by("doc_id", F.struct("shared", -F.col("doc_id"))).alias("centre"))
    rows = kept(rows.join(kept(centre, "bucket-centres"), "bucket").select("bucket", "doc_id", "centre"), "centred-members")
    once = named.where("doc_id is not null")
    pairs = kept(rows.where("doc_id != centre").select("centre", "doc_id").distinct(), "star-pairs")
    checked = kept(similarities(pairs, once, size).groupBy("centre", "doc_id").agg(F.max_by(F.struct("both", "either"), F.col("both") / F.col("either")).alias("x")).select("centre", "doc_id", "x.*"), "star-similarities")
    links = checked.where(F.col("both") * 100 >= F.col("either") * percent).select(F.col("centre").alias("a"), F.col("doc_id").alias("b"))
    found = connected_components(links)
    used.append(found)
    far = 1 - 2 * (1 - percent / 100) - 1e-9
    of = found.withColumnRenamed("node", "doc_id")
    state = (
        rows.join(of, "doc_id", "left")
        .join(found.select(F.col("node").alias("centre"), F.col("component").alias("centre_component")), "centre", "left")
        .join(checked, ["centre", "doc_id"], "left")
        .withColumn("component", F.coalesce("component", "doc_id"))
        .withColumn("centre_component", F.coalesce("centre_component", "centre"))
        .withColumn("similar", F.when(F.col("doc_id") == F.col("centre"), 1.0).otherwise(F.col("both") / F.col("either")))
    )
    apart = F.col("component") != F.col("centre_component")
    state = kept(state.select("bucket", F.col("centre_component").alias("cluster"), "doc_id", "component", apart.alias("apart"), (F.col("similar") >= percent / 100 - 1e-12).alias("direct"), (F.col("similar") >= far).alias("ring")), "bucket-states")
    ringed = state.groupBy("bucket").agg(F.max(F.col("apart") & F.col("ring")).alias("ringed"), F.max("apart").alias("any_apart")).where("any_apart")
    open_rows = state.join(kept(ringed, "ringed-buckets"), "bucket").where("apart or not direct or ringed")
    # buckets whose centres are in one component are looked at together: each document once
    members = kept(open_rows.select("cluster", "doc_id", "component").distinct(), "open-members")
    several = members.groupBy("cluster").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("cluster")
    members = kept(members.join(several, "cluster", "left_semi"), "unfinished-members")
    if not members.isEmpty():
        more = kept(_unfinished(members.join(reps.select("doc_id", "signature"), "doc_id"), once, size, percent), "more-links")
        if not more.isEmpty():
            # links between components: only these are joined anew
            name = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
            between = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
            used.append(connected_components(between))
            wider = used[-1].select(F.col("node").alias("component"), F.col("component").alias("wider"))
            found = found.unionAll(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
            found = kept(found.join(wider, "component", "left").select("node", F.coalesce("wider", "component").alias("component")), "components")
    final = reps.select("s1", "s2", "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    final = stored(final.select("s1", "s2", F.coalesce("component", "doc_id").alias("component_id")), "set-components")
    dropped(*used)
    out = sig.where("doc_id is not null").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("s1")).alias("s1"), F.when(F.col("n_shingles") > 0, F.col("s2")).alias("s2")).join(final, ["s1", "s2"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    lone = sig.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.union(lone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group (the smallest id), columns as they were; rows without an id stay."""
    gone = stored(near_duplicates(docs, size, percent, key, text).where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "near-duplicates")
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")
