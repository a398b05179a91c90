"""Embedding whitening: principal components of unit variance from an exact fit list.

Entries become whole numbers x = floor(SCALE * c) + SHIFT. The fit list is each distinct x once: n vectors with sums S
per dimension. Three passes over it, each a map over partitions whose partial sums are added by dimension (one row for
a task and dimension, never a vector's rows in one place):

1. n and S, exactly.
2. The scatter of x - S/n. The vectors are centred before they are multiplied: x less the whole part of S/n is exact.
3. The covariance of what was whitened, to be told from the identity.

Between the second and third the driver works on the dimensions only (a square of them, whatever the rows): a Cholesky
factor with pivots (`pivoted_cholesky`) and one-sided Jacobi rotations of its columns (`jacobi`). Of scatter / n = L L',
rotations make L's columns orthogonal; then their squared norms are the eigenvalues and the columns over their norms
the components.

Rows whose vector is null, without entries, or holds a null or non-finite entry have no result. Repeated vectors
count once in the fit and have a result each; repeated ids and null ids are rows like others. An empty table, or one whose
vectors are all equal, has no components and gives no rows; neither do components beyond the rank. Vectors of different
lengths are an error. Where SCALE * c passes 64 bits x is the nearest 64-bit value; a deviation that passes 64 bits is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from handspan.llm.shared import column, dropped, stored

SCALE, SHIFT = 64, 1_000_000
#: Rotations end when no two columns have a cosine beyond this.
ORTHOGONAL = 1e-15
_MOST_SWEEPS = 60
#: Whole numbers from here on are centred as doubles, as their difference might pass 64 bits.
_FAR = 1 << 62


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L of full column rank with a = L L', its rows in a's order: at each step the largest diagonal entry that is left leads."""
    left, d = a.astype(float), len(a)
    columns: list[np.ndarray] = []
    diagonal = np.diag(left).copy()
    least = d * np.finfo(float).eps * diagonal.max(initial=0.0)
    while len(columns) < d:
        p = int(np.argmax(diagonal))
        if diagonal[p] <= least:
            break
        known = np.array(columns).T if columns else np.zeros((d, 0))
        c = (left[:, p] - known @ known[p]) / np.sqrt(diagonal[p])
        c[diagonal < 0] = 0.0  # rows that have led
        columns.append(c)
        diagonal -= c * c
        diagonal[p] = -np.inf
    return np.array(columns).T.reshape(d, len(columns))


def _rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of n columns once, in rounds of pairs without a column in common."""
    ring = list(range(n + n % 2))
    out = []
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], ring[::-1], strict=False) if max(a, b) < n]
        out.append((np.array([min(p) for p in pairs]), np.array([max(p) for p in pairs])))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues from the largest, unit eigenvectors as columns) of factor @ factor.T, by rotations of the factor's columns."""
    g = factor.copy()
    rounds = _rounds(g.shape[1])
    for _ in range(_MOST_SWEEPS):
        turned = 0.0
        for i, j in rounds:
            if not len(i):
                continue
            x, y = g[:, i], g[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            cosine = np.abs(xy) / np.sqrt(np.maximum(xx * yy, np.finfo(float).tiny))
            turned = max(turned, cosine.max(initial=0.0))
            turn = cosine > ORTHOGONAL
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                z = (yy - xx) / (2 * xy)
                t = np.where(turn, np.sign(z + (z == 0)) / (np.abs(z) + np.sqrt(1 + z * z)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            g[:, i], g[:, j] = c * x - c * t * y, c * t * x + c * y
        if turned <= ORTHOGONAL * len(g):
            break
    norm = np.sqrt((g * g).sum(0))
    order = np.argsort(-norm, kind="stable")
    norm = norm[order]
    return norm * norm, g[:, order] / norm


def whole_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): the rows that take part, their entries as whole numbers."""
    c = column(vector)
    fit = c.isNotNull() & (F.size(c) > 0) & ~F.exists(c, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    x = F.transform(c, lambda e: F.least(F.floor(e.cast("double") * SCALE).cast("long"), F.lit((1 << 63) - 1 - SHIFT)) + SHIFT)
    return vectors.where(fit).select(column(key).alias("vec_id"), x.alias("x"))


def _table(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A list column of a batch as a table of whole numbers."""
    lists = batch.column(batch.schema.get_field_index(name))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _summed(rows: DataFrame, work, width: int) -> np.ndarray:
    """The sums of work(table) -> an array of `width` columns, over all batches of rows: added in each task, then by row of the array."""

    def partial(batches):
        total = None
        for b in batches:
            if b.num_rows:
                part = work(_table(b, "x"))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(total)), pa.int32()), "v": pa.array(list(total.astype(float)), pa.list_(pa.float64()))})

    some = rows.select("x").mapInArrow(partial, "i int, v array<double>")
    added = some.groupBy("i").agg(F.array(*[F.sum(F.get("v", F.lit(k))) for k in range(width)]).alias("v"))
    return np.array([r["v"] for r in added.orderBy("i").collect()], float).reshape(-1, width)


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """(vectors of the fit list, exact sums by dimension)."""

    def partial(batches):
        n, total = 0, [0] * width
        for b in batches:
            if b.num_rows:
                t = _table(b, "x")
                n += len(t)
                low = (t & 0xFFFFFFFF).sum(axis=0)
                total = [a + (int(h) << 32) + int(w) for a, h, w in zip(total, (t >> 32).sum(axis=0), low, strict=True)]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, width), pa.int32()), "v": pa.array([str(v) for v in [n, *total]])})

    added = fit.select("x").mapInArrow(partial, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found = {r["i"]: int(r["v"]) for r in added.collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(width)]


def whiten(vectors: DataFrame, most: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row that takes part and each component, `most` at most."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, key, vector)
    widths = [r[0] for r in rows.select(F.size("x").alias("w")).groupBy("w").count().limit(2).collect()]
    if len(widths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(widths)}")
    if not widths:
        return spark.createDataFrame([], schema)
    d = widths[0]
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    n, sums = _sums(fit, d)
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([(s % n) / n for s in sums])

    def centred(x: np.ndarray) -> np.ndarray:
        near = -_FAR < int(min(x.min(), whole.min())) and int(max(x.max(), whole.max())) < _FAR
        return (x - whole if near else x.astype(float) - whole).astype(float) - part

    def scatter(x: np.ndarray) -> np.ndarray:
        y = centred(x)
        return y.T @ y

    v = _summed(fit, scatter, d) / n
    values, components = jacobi(pivoted_cholesky((v + v.T) / 2))
    k = min(most, len(values))
    if not k:
        dropped(fit)
        return spark.createDataFrame([], schema)
    turn = components[:, :k] / np.sqrt(values[:k])

    def second(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ turn
        return np.vstack([w.T @ w, w.sum(axis=0)])

    moments = _summed(fit, second, k) / n
    dropped(fit)
    error = float(np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)).max())
    explained = values[:k] / np.trace(v)
    rest = np.array([s % n for s in sums], np.int64)

    def work(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _table(b, "x")
            w = centred(x) @ turn
            far = np.abs(x.astype(float) - whole).max(axis=1) * n + n
            with np.errstate(over="ignore"):
                deviation = ((n * (x - whole) - rest) ** 2).sum(axis=1)  # n * x - S = n * (x - whole) - rest
            fits = far * far * d < 2.0**62
            exact = [int(v) if ok else _deviation(row, n, sums) for v, ok, row in zip(deviation.tolist(), fits.tolist(), x, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, n)),
                    pa.array([v for v in exact for _ in range(k)], pa.int64()),
                    pa.array(w.reshape(-1)),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(x) * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(F.col("vec_id").cast("long"), "x").mapInArrow(work, schema)


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> int | None:
    """A deviation in whole numbers of any size; None past 64 bits."""
    v = sum((n * int(e) - s) ** 2 for e, s in zip(x, sums, strict=True))
    return v if v < 1 << 63 else None
