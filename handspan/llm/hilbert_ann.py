"""Nearest neighbours by shifted space-filling curves.

Each curve projects the unit vectors on a few random orthogonal directions, shifts and quantises them, and
orders them by their Hilbert key; Spark range-partitions and sorts each order and numbers it. A query's
candidates are the rows within a window on either side of its own place, on every curve; cosines on the
original vectors rerank them.

How wide a window must be depends on the data: clustered vectors need narrow ones, and for noise in many
dimensions no order keeps neighbours close. The index therefore measures: for SAMPLE_QUERIES query vectors
the true neighbours are found in one pass over all rows, and the window is the distance in rank, on the
nearest curve, that reaches `recall` of them. Every row is indexed and takes part.

Equal vectors are one entry with their smallest ids, so that a vector that many rows share is no window full
of ties. Windows are read in blocks of BLOCK_ROWS; the queries of a block are split where they are many.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from handspan.llm.shared import dropped, stored

CURVES, DIMENSIONS, BITS = 4, 8, 7
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
SAMPLE_QUERIES = 96
#: More than a product of unit vectors is off by, and how many exact cosines are computed at once.
ROUNDING = 1e-9
PAIRS = 1 << 16
RECALL = 0.97


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each cell (rows of unsigned coordinates below 2**bits) on the Hilbert curve, as an integer."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[:, i] & q) > 0
            swap = (x[:, 0] ^ x[:, i]) & p
            x[:, 0] = np.where(high, x[:, 0] ^ p, x[:, 0] ^ swap)
            x[:, i] = np.where(high, x[:, i], x[:, i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[:, n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a binary column, a row each, times a power of two that brings the largest component to about 1.

    Cosines and directions are the same, but no square of a tiny or huge component leaves the range of doubles.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.empty((0, 0))
    if len(pc.unique(pc.binary_length(column))) > 1:
        raise ValueError("vectors of different lengths")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    v = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float64).reshape(n, -1)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def curve_keys(vectors: np.ndarray, curve: int) -> np.ndarray:
    """The Hilbert keys of vectors on a curve: its own projection and shift, from its number only."""
    d = vectors.shape[1]
    k = min(DIMENSIONS, d)
    rng = np.random.default_rng([curve, d])
    directions = np.linalg.qr(rng.standard_normal((d, k)))[0]
    spread = 3.0 / math.sqrt(d)
    at = np.clip(_unit(vectors) @ directions / spread, -1, 1) / 2 + 0.5
    cells = np.minimum((at + rng.random(k)) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.int64)
    return hilbert_keys(cells, BITS)


def _cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The cosine of each pair of rows, in double precision."""
    return (q * v).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))


def _best(q_unit: np.ndarray, rows: np.ndarray, unit: np.ndarray, q: np.ndarray, k: int, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k nearest rows of each query; of equal scores those of the smaller entries."""
    if not len(q) or not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    near = q_unit @ unit.T
    m = min(k, len(rows))
    least = np.partition(near, len(rows) - m, axis=1)[:, [len(rows) - m]]
    i, j = np.nonzero(near >= least - ROUNDING)  # all that may tie with the m-th
    score = np.concatenate([_cosines(q[i[a : a + PAIRS]], rows[j[a : a + PAIRS]]) for a in range(0, len(i), PAIRS)])
    order = np.lexsort((entry[j], -score, i))
    place = np.arange(len(order)) - np.searchsorted(i, i)  # i is sorted before and after
    order = order[place < m]
    return i[order], j[order], score[order]


def usable_vectors(vectors: DataFrame, queries, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vector, asked) of the rows that take part; a vector is the bytes of its components in double precision."""

    def work(batches):
        for b in batches:
            ids, column, asked = b.columns
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            value = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # null components are not finite now, and no zero has a sign
            row = np.repeat(np.arange(len(size)), size)
            bad, some = np.bincount(row, ~np.isfinite(value), len(size)), np.bincount(row, value != 0, len(size))
            good = np.flatnonzero(np.asarray(ids.is_valid()) & (bad == 0) & (some > 0))
            end = np.cumsum(size)
            data = [value[z - n : z].tobytes() for z, n in zip(end[good].tolist(), size[good].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(good)), pa.array(data, pa.binary()), asked.take(pa.array(good))], names=["id", "vector", "asked"])

    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asked"))
    return rows.mapInArrow(work, "id long, vector binary, asked boolean")


def distinct_vectors(usable: DataFrame, k: int) -> DataFrame:
    """(entry, vector, ids, asked): one row per distinct vector; entry is its smallest id, ids its k + 1 smallest, asked whether it holds a query."""
    v = usable.withColumn("h", F.xxhash64("vector"))
    asked = v.groupBy("h", "vector").agg(F.max("asked").alias("asked"), F.min("id").alias("entry"))
    place = Window.partitionBy("h", "vector").orderBy("id")
    few = v.select("h", "vector", "id").withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1)  # cut per task before the exchange
    ids = few.groupBy("h", "vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return asked.join(ids, ["h", "vector"]).select("entry", "vector", "ids", "asked")


def _ordered(entries: DataFrame) -> DataFrame:
    """(curve, rank, entry, vector, ids, asked), a stored table: every entry on every curve, with its place in the curve's order."""

    def keys(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(1))
            for c in range(CURVES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, np.int32)), pa.array(curve_keys(v, c)), *b.columns], names=["curve", "key", *b.schema.names])

    def number(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n)), *b.columns], names=["part", "at", *b.schema.names])
            seen += n

    inner = "entry long, vector binary, ids array<long>, asked boolean"
    keyed = entries.mapInArrow(keys, f"curve int, key long, {inner}").repartitionByRange("curve", "key", "entry").sortWithinPartitions("curve", "key", "entry")
    numbered = stored(keyed.mapInArrow(number, f"part int, at long, curve int, key long, {inner}"), "curves")
    sizes = numbered.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # a few rows for each part
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).select("curve", "part", "before")
    placed = numbered.join(F.broadcast(sizes), ["curve", "part"]).select("curve", (F.col("before") + F.col("at")).alias("rank"), "entry", "vector", "ids", "asked")
    placed = stored(placed, "ordered-vectors")
    dropped(numbered)
    return placed


def _window(ordered: DataFrame, entries: DataFrame, n: int, k: int) -> int:
    """Half the width that reaches RECALL of the true neighbours of a bounded sample of queries."""
    asked = entries.where("asked").orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE_QUERIES).select("entry", "vector").collect()
    if not asked:
        return 0
    q, own = _matrix(pa.array([bytes(r.vector) for r in asked], pa.binary())), np.array([r.entry for r in asked])
    q_unit = _unit(q)

    def nearest(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v, ids = _matrix(b.column(1)), b.column(0).to_numpy()
            i, j, s = _best(q_unit, v, _unit(v), q, k + 1, ids)
            apart = ids[j] != own[i]
            yield pa.RecordBatch.from_arrays([pa.array(own[i[apart]]), pa.array(ids[j[apart]]), pa.array(s[apart])], names=["query", "entry", "score"])

    true = entries.select("entry", "vector").mapInArrow(nearest, "query long, entry long, score double")
    true = true.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entry"))).where(F.col("r") <= k).select("query", "entry")
    true = stored(true, "true-neighbours")
    wanted = F.broadcast(true)  # at most SAMPLE_QUERIES * k rows
    places = ordered.select("curve", "rank", "entry")
    there = places.join(wanted, "entry").select("query", "entry", "curve", "rank")
    here = places.join(F.broadcast(wanted.select("query").distinct()), places["entry"] == F.col("query")).select("query", "curve", F.col("rank").alias("own_rank"))
    apart = there.join(here, ["query", "curve"]).groupBy("query", "entry").agg(F.min(F.abs(F.col("rank") - F.col("own_rank"))).alias("apart"))
    got = sorted(r[0] for r in apart.select("apart").collect())
    dropped(true)
    return min(int(got[min(len(got) - 1, math.ceil(RECALL * len(got)) - 1)]) + 1, n) if got else 0


def nearest(vectors: DataFrame, queries, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row where the Column `queries` holds, by cosine; ties go to the smaller id.

    A query is never its own neighbour, but rows of an equal vector are. Vectors that are null, empty or zero, or
    hold null or non-finite components, take no part; all others must have one length (others are an error). With
    fewer candidates all are returned; an empty table or no query gives no rows. Rows that repeat an id and a vector
    count as one; of an id's different vectors each may be found, and the largest cosine counts. A null id takes no
    part. Other columns are not read.
    """
    usable = stored(usable_vectors(vectors, queries, key, vector), "usable-vectors")
    entries = stored(distinct_vectors(usable, k), "vectors")
    n = entries.count()
    ordered = _ordered(entries)
    half = _window(ordered, entries, n, k)
    block = F.floor(F.col("rank") / BLOCK_ROWS).cast("long")
    share = entries.where("asked").count() / max(n, 1)
    salts = max(1, math.ceil((2 * half + 2 * BLOCK_ROWS) * share / QUERY_ROWS))  # about QUERY_ROWS queries meet a block in a task
    salt = F.pmod(F.xxhash64("entry"), F.lit(salts)).cast("int")
    last = F.floor(F.least(F.col("rank") + half, F.lit(max(n - 1, 0))) / BLOCK_ROWS).cast("long")
    first = F.floor(F.greatest(F.col("rank") - half, F.lit(0)) / BLOCK_ROWS).cast("long")
    asking = ordered.where("asked").select("curve", salt.alias("salt"), F.explode(F.sequence(first, last)).alias("block"), "rank", "entry", "vector")
    rows = ordered.select("curve", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), block.alias("block"), "rank", "entry", "vector", "ids")

    def search(q, r):
        out = {"query": [], "entry": [], "ids": [], "score": []}
        if q.num_rows and r.num_rows:
            qv, rv = _matrix(q.column("vector")), _matrix(r.column("vector"))
            i, j, s = _best(_unit(qv), rv, _unit(rv), qv, k + 1, r.column("entry").to_numpy())
            ids = r.column("ids").combine_chunks()
            return pa.table({"query": q.column("entry").combine_chunks().take(pa.array(i)), "entry": r.column("entry").combine_chunks().take(pa.array(j)), "ids": ids.take(pa.array(j)), "score": pa.array(s)})
        return pa.table({"query": pa.array(out["query"], pa.int64()), "entry": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})

    keys = ["curve", "block", "salt"]
    found = asking.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(search, "query long, entry long, ids array<long>, score double")
    found = found.groupBy("query", "entry").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entry"))).where(F.col("r") <= k + 1)
    found = stored(found.select("query", "score", "ids"), "nearest-vectors")
    of = entries.where("asked").select(F.col("entry").alias("query"), "vector", F.xxhash64("vector").alias("h"))
    asked = usable.where("asked").select(F.col("id").alias("query_id"), F.col("vector").alias("own"), F.xxhash64("vector").alias("h"))
    asked = asked.join(of, "h").where(F.col("own") == F.col("vector")).select("query_id", "query").distinct()
    each = asked.join(found, "query").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    out = stored(out, "neighbours")
    dropped(usable, entries, ordered, found)
    return out
