"""Toxicity by cumulative-link ordinal regression on sparse text features.

Labels above 1 are severity grades and are taken as they are. Where labels say only whether a text is toxic, grade 0
is not toxic and 1..3 are thirds of the toxic rows by how much of the distinctly toxic vocabulary they use: an
order of severity that comes from the texts, as the labels have none. One weight vector serves all thresholds:
P(grade >= k) = 1 / (1 + exp(t_k - w x)) with t_1 < t_2 < .., and the expected severity is the sum of these
probabilities.

Features are the white-space words and their leading 4, 5 and 6 bytes (A-Z lower-cased, outer ASCII
punctuation cut), hashed to 64 bits; x is log(1 + count). The model is fitted on a bounded sample of labelled
rows (SAMPLE_ROWS, the smallest by a hash of their ids); all rows are scored, over whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from handspan.llm.packed import frees_memory
from handspan.llm.shared import carried, dropped, numbered, stored
from handspan.llm.text import LOWER, NOT_ALNUM, U64, blocks, mix, slice_hashes, words

#: Most labelled rows that the model is fitted on.
SAMPLE_ROWS = 20_000
#: Most features of the model; those that tell the labels apart best.
MOST_FEATURES = 4_000
PREFIXES = (4, 5, 6)
GRADES = 3
LEAST_Z = 5.0
#: A feature is in this part of the toxic rows of the sample at least, and in three of them, so that no few copies of one text make features of all its words.
LEAST_SHARE = 0.01
LEAST_LIFT = 3.0


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash, row) of every feature of a block, one pair of arrays for each kind of feature."""
    low = LOWER[data]
    start, end, row = words(low, offsets, NOT_ALNUM)
    out = [(slice_hashes(low, start, end), row)]
    for k in PREFIXES:
        at = end - start > k
        out.append((mix(slice_hashes(low, start[at], start[at] + k) + U64(k)), row[at]))
    return out


def _counted(batch: pa.RecordBatch, keys: np.ndarray):
    """(row, feature, count) over a batch of the features in keys, which must be sorted."""
    got = zip(*[(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)), *_counted_blocks(batch, keys)])
    return tuple(map(np.concatenate, got))


def _counted_blocks(batch: pa.RecordBatch, keys: np.ndarray | None = None):
    """(row, feature, count) of a batch, block by block; with keys only of those features."""
    known = None
    if keys is not None:
        known = np.zeros(1 << 20, bool)
        known[(keys >> U64(44)).astype(np.int64)] = True
    for first, _, data, offsets in blocks(batch, "_text"):
        own_f, own_r = [], []
        for h, row in features(data, offsets):
            if known is not None:
                at = np.flatnonzero(known[(h >> U64(44)).astype(np.int64)])
                h, row = h[at], row[at]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1) if len(keys) else np.empty(0, np.int64)
                fit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                h, row = h[fit], row[fit]
            own_f.append(h)
            own_r.append(row + first)
        f, r = np.concatenate(own_f), np.concatenate(own_r)
        order = np.lexsort((f, r))
        f, r = f[order], r[order]
        at = np.flatnonzero(np.append(True, (f[1:] != f[:-1]) | (r[1:] != r[:-1]))) if len(f) else np.empty(0, np.int64)
        yield r[at], f[at], np.diff(np.append(at, len(f)))


class Model:
    """keys: sorted features; weights: theirs; cuts: the ordered thresholds."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, cuts: np.ndarray):
        self.keys, self.weights, self.cuts = keys, weights, cuts

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. of each linear score."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - x[:, None], -500, 500)))


def fit_ordinal(row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, n_features: int, grades: int = GRADES, l2: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that minimise the cumulative-link loss over sparse rows, by Adam.

    Thresholds are the first one plus sums of exponentials, so they stay ordered.
    """
    n = max(len(grade), 1)
    w, a = np.zeros(n_features), np.zeros(grades)
    share = np.array([(grade >= k).mean() if len(grade) else 0 for k in range(1, grades + 1)])
    share = np.clip(share, 1e-4, 1 - 1e-4)
    first = np.log((1 - share) / share)
    a[0] = first[0]
    a[1:] = np.log(np.maximum(np.diff(first), 1e-2))
    m = [np.zeros(n_features), np.zeros(grades)]
    v = [np.zeros(n_features), np.zeros(grades)]
    eps = 1e-12
    for step in range(1, steps + 1):
        gaps = np.exp(a[1:])
        cuts = a[0] + np.concatenate([[0], np.cumsum(gaps)])
        x = np.bincount(row, value * w[column], minlength=n)[:n] if len(row) else np.zeros(n)
        at_least = np.column_stack([np.ones(n), 1 / (1 + np.exp(np.clip(cuts[None, :] - x[:, None], -60, 60))), np.zeros(n)])
        slope = at_least * (1 - at_least)
        i = np.arange(n)
        p = np.maximum(at_least[i, grade] - at_least[i, grade + 1], eps) if len(grade) else np.ones(n)
        lo = slope[i, grade] / p if len(grade) else np.zeros(n)
        hi = slope[i, grade + 1] / p if len(grade) else np.zeros(n)
        dx = -(lo - hi) / n
        d_cut = np.zeros(grades)
        for k in range(1, grades + 1):
            d_cut[k - 1] = (lo[grade == k].sum() - hi[grade == k - 1].sum()) / n if len(grade) else 0
        d_a = np.concatenate([[d_cut.sum()], gaps * np.cumsum(d_cut[::-1])[::-1][1:]])
        d_w = (np.bincount(column, value * dx[row], minlength=n_features) if len(row) else np.zeros(n_features)) + l2 * w / n * 10
        for j, (par, d) in enumerate(((w, d_w), (a, d_a))):
            m[j] = 0.9 * m[j] + 0.1 * d
            v[j] = 0.99 * v[j] + 0.01 * d * d
            par -= 0.1 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-9)
    return w, a[0] + np.concatenate([[0], np.cumsum(np.exp(a[1:]))])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model from labelled documents; rows whose label or id is null aren't labelled, a repeated id takes its largest label.

    Labels are 0 or 1, or grades from 0 up. Without toxic labels nothing is toxic; without any features only the share
    of labels counts; a null text has no features; of the rows of one id that whose text has the least hash is used; an empty table of labels or documents
    is like one without toxic labels. No other column of either table is read.
    """
    named = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("y")).where("key is not null and y is not null")
    named = named.groupBy("key").agg(F.max("y").alias("y"))
    sample = named.orderBy(F.xxhash64("key"), "key").limit(sample_rows)
    labelled = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("_text")).join(F.broadcast(sample), "key")
    least = F.min_by(F.col("_text"), F.struct(F.col("_text").isNull(), F.xxhash64("_text")))  # a row of each id, so that the sample is bounded
    texts = stored(labelled.groupBy("key").agg(least.alias("_text"), F.first("y").alias("y")).select("_text", "y"), "labelled-texts")

    def each(batches):
        for b in batches:
            toxic = b.column(1).to_numpy(zero_copy_only=False) > 0
            for r, f, _ in _counted_blocks(b):
                if not len(f):
                    continue
                order = np.argsort(f, kind="stable")
                f, y = f[order], toxic[r[order]]
                at = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
                yield pa.RecordBatch.from_pydict({"f": f[at].view(np.int64), "n": np.diff(np.append(at, len(f))).astype(np.int64), "pos": np.add.reduceat(y, at, dtype=np.int64)})

    n_all, n_pos = texts.agg(F.count("*"), F.sum((F.col("y") > 0).cast("long"))).first()
    n_pos = n_pos or 0
    n_neg = n_all - n_pos
    if not n_pos:
        dropped(texts)
        return Model(np.empty(0, np.uint64), np.empty(0), np.full(GRADES, 50.0) + np.arange(GRADES))
    p1, p0 = F.col("pos") / n_pos, (F.col("n") - F.col("pos")) / max(n_neg, 1)
    mean = F.col("n") / n_all
    z = (p1 - p0) / F.sqrt(mean * (1 - mean + 1e-9) * (1 / n_pos + 1 / max(n_neg, 1)))
    stats = texts.mapInArrow(frees_memory(each), "f long, n long, pos long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).where(F.col("pos") >= max(3, int(LEAST_SHARE * n_pos)))
    best = stats.withColumn("z", z).where((F.col("z") >= LEAST_Z) & (p1 >= LEAST_LIFT * p0)).orderBy(F.desc("z"), "f").limit(MOST_FEATURES)
    keys = np.sort(np.array([r[0] for r in best.select("f").collect()], np.int64).view(np.uint64))

    def chosen(batches):
        for b in batches:
            r, f, n = _counted(b, keys)
            n_rows = b.num_rows
            at = np.searchsorted(r, np.arange(n_rows + 1))
            column = np.searchsorted(keys, f)
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.ListArray.from_arrays(at.astype(np.int32), pa.array(column, pa.int32())), pa.ListArray.from_arrays(at.astype(np.int32), pa.array(n, pa.int32()))],
                names=["y", "c", "n"],
            )

    rows = texts.mapInArrow(frees_memory(chosen), "y int, c array<int>, n array<int>").collect()  # at most SAMPLE_ROWS rows of MOST_FEATURES features
    dropped(texts)
    rows.sort(key=lambda r: (r[0], r[1], r[2]))  # sums of floating-point numbers depend on the order
    grade = np.array([max(r[0], 0) for r in rows], np.int64)
    grades = int(grade.max())
    if grades == 1:
        grades, y = GRADES, grade > 0
        used = np.array([sum(r[2]) for r in rows], float)
        grade[y] = 1 + np.searchsorted(np.quantile(used[y], [1 / 3, 2 / 3]), used[y], "left")
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    column = np.array([c for r in rows for c in r[1]], np.int64)
    value = np.log1p(np.array([c for r in rows for c in r[2]], float))
    w, cuts = fit_ordinal(row, column, value, grade, len(keys), grades)
    return Model(keys, w, cuts)


def severity(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds to each row: p_toxic (P(grade >= 1)), severity (the expected grade), grade (the likeliest) and rejected (p_toxic >= 0.5).

    A null or empty text has no features; nulls in other columns stay; repeated rows are scored each; a very long
    text is scored whole; an empty table gives no rows; of equally likely grades the lower one is taken. `keep`
    names the columns of docs to return (default: all); columns that clash with the new names are replaced, and any
    other name may occur.
    """
    own, schema = carried(docs, text, {"p_toxic": "double", "severity": "double", "grade": "int", "rejected": "boolean"}, keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_FEATURES weights

    def work(batches):
        m = shared.value
        for b in batches:
            r, f, n = _counted(b, m.keys)
            x = np.bincount(r, np.log1p(n) * m.weights[np.searchsorted(m.keys, f)], minlength=b.num_rows)[: b.num_rows] if len(r) else np.zeros(b.num_rows)
            p = m.probabilities(x)
            each = np.column_stack([1 - p[:, 0], p[:, :-1] - p[:, 1:], p[:, -1]])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array(p[:, 0]), pa.array(p.sum(axis=1)), pa.array(each.argmax(axis=1), pa.int32()), pa.array(p[:, 0] >= 0.5)], names=schema.names
            )

    return own.mapInArrow(frees_memory(work), schema)


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the rejected rows, columns as they were."""
    names = docs.columns
    scored = severity(numbered(docs), model, f"c_{names.index(text)}")
    return scored.where(~F.col("rejected")).select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(names)])
