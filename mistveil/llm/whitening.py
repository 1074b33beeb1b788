"""Whitening of embeddings: an exact distributed scatter, and a cyclic Jacobi eigensolver on the driver.

Entries are whole numbers (floor of SCALE times the entry, plus OFFSET). Each task multiplies entries less a common centre, a whole number
near the mean, so that the offset never enters a product; products and their sums are whole numbers below 2^53 in a block
and decimals beyond, so nothing is rounded before the covariance is. Only sums of one row for each pair of dimensions reach the driver: their
number depends on the dimensions, not on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

SCALE, OFFSET = 64, 1_000_000
#: Components that are returned at most, rows of a block, sweeps after which rotations must have settled.
COMPONENTS, BLOCK, SWEEPS = 32, 4096, 60
#: Largest whole number that is exact as a double; entries beyond it can't be told apart, nor their products summed.
EXACT = 1 << 53
#: Largest long.
_LONG = (1 << 63) - 1

_SCATTER = "i int, j int, total decimal(38,0)"
_WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def entries(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array of long) of the rows whose embedding is neither null nor empty nor holds null or non-finite entries.

    Rows whose number of entries isn't the most frequent one (the larger one of several) are left out: they share no space with the others.
    """
    x = F.transform("embedding", lambda c: (F.floor(F.lit(float(SCALE)) * c.cast("double")) + OFFSET).cast("long"))
    fit = F.size("embedding") > 0
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < EXACT / SCALE / 2))
    infinite = F.exists("embedding", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull() & fit).where(~F.coalesce(infinite, F.lit(True)))
    too_large = F.raise_error(F.lit(f"an entry is beyond {EXACT // SCALE // 2} and not exact as a whole number"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, x).otherwise(too_large.cast("array<long>")).alias("x"))
    usual = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("x") == (usual[0] if usual else 0))


def _matrices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _partial(i: np.ndarray, j: np.ndarray, total: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([str(t) for t in total]).cast(pa.decimal128(38, 0))], names=["i", "j", "total"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number (i = -1) and sum of each entry over a task's rows."""
    n, total = 0, None
    for _, x in _matrices(batches, 0):
        part = np.array(x.sum(axis=0).tolist(), object)  # a batch of whole numbers below 2^53 can't overflow
        n, total = n + len(x), part if total is None else total + part
    if n:
        yield _partial(np.arange(-1, len(total)), np.full(len(total) + 1, -1), [n, *total.tolist()])


def _scatter(centre: list[int]):
    """Sums of products of centred entries over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, (rows, columns) = np.array(centre), np.triu_indices(len(centre))
        total = np.zeros((len(centre), len(centre)), object)
        for _, x in _matrices(batches, 0):
            y = x - at
            step = EXACT // max(1, int(np.abs(y).max()) ** 2)
            for s in range(0, len(y), max(1, step)):
                part = y[s : s + max(1, step)]
                if step:  # all sums are whole numbers below 2^53: exact as doubles
                    total += (part.T.astype(np.float64) @ part.astype(np.float64)).astype(np.int64)
                else:
                    total += part.T.astype(object) @ part.astype(object)
        yield _partial(rows, columns, total[rows, columns].tolist())

    return run


def _totals(x: DataFrame, run) -> dict[tuple[int, int], int]:
    """The partial sums of all tasks, added up in Spark: a row for each pair of dimensions."""
    return {(r.i, r.j): int(r.total) for r in x.mapInArrow(run, _SCATTER).groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}


def jacobi(a: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric positive semidefinite matrix, by cyclic Jacobi rotations.

    An entry is rotated away while it is large against the two diagonal entries it couples, not against the whole matrix: so small
    eigenvalues come out as exactly as large ones. Zero eigenvalues are as near zero as rounding leaves them.
    """
    a = np.array(a, np.float64)
    n, v = len(a), np.eye(len(a))
    eps = np.finfo(np.float64).eps
    for _ in range(sweeps):
        turned = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                apq, app, aqq = a[p, q], a[p, p], a[q, q]
                if apq == 0 or abs(apq) <= eps * np.sqrt(abs(app)) * np.sqrt(abs(aqq)):
                    continue
                turned = True
                theta = (aqq - app) / (2 * apq)
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s, keep = t * c, (app - t * apq, aqq + t * apq)
                row_p, row_q = a[p].copy(), a[q].copy()
                a[p], a[q] = c * row_p - s * row_q, s * row_p + c * row_q
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q] = keep
                a[p, q] = a[q, p] = 0.0
                v_p = v[:, p].copy()
                v[:, p], v[:, q] = c * v_p - s * v[:, q], s * v_p + c * v[:, q]
        if not turned:
            break
    else:
        raise RuntimeError("Jacobi rotations did not settle")
    e = np.diag(a)
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, list]:
    """n * x - S for each row, in whole numbers, so that subtracting the mean rounds nothing, and its sum of squares (None beyond a long)."""
    if n * int(np.abs(x).max()) + int(max(abs(sums))) <= _LONG:
        y = x * n - sums.astype(np.int64)
        if float(np.abs(y).max()) ** 2 * x.shape[1] < _LONG / 2:
            return y, (y * y).sum(axis=1).tolist()
        y = y.astype(object)
    else:
        y = x.astype(object) * n - sums
    return y, [t if t <= _LONG else None for t in (y * y).sum(axis=1).tolist()]


def _whitened(x: np.ndarray, n: int, sums: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, list]:
    y, deviation = _deviations(x, n, sums)
    return (y / n).astype(np.float64) @ matrix, deviation


def _moments(n: int, sums: np.ndarray, matrix: np.ndarray):
    """Sums (j = -1) and sums of products of a task's whitened rows."""
    k = matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linear, square = np.zeros(k), np.zeros((k, k))
        for _, x in _matrices(batches, 0):
            z, _ = _whitened(x, n, sums, matrix)
            linear, square = linear + z.sum(axis=0), square + z.T @ z
        i, j = np.indices((k, k), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[i.ravel(), np.arange(k, dtype=np.int32)]), pa.array(np.r_[j.ravel(), np.full(k, -1, np.int32)]), pa.array(np.r_[square.ravel(), linear])], names=["i", "j", "total"])

    return run


def _identity_error(x: DataFrame, n: int, sums: np.ndarray, matrix: np.ndarray) -> float:
    """The largest entry of the covariance of the whitened rows less the identity, measured over all of them."""
    k = matrix.shape[1]
    rows = x.mapInArrow(_moments(n, sums, matrix), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    total = {(r.i, r.j): r.total / n for r in rows}
    return max(abs(total[i, j] - total[i, -1] * total[j, -1] - (i == j)) for i in range(k) for j in range(k))


def _rows(n: int, sums: np.ndarray, matrix: np.ndarray, explained: list[float], error: float):
    k = matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches, 1):
            for s in range(0, len(x), BLOCK):
                z, deviation = _whitened(x[s : s + BLOCK], n, sums, matrix)
                each = np.repeat(np.arange(len(z)), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(each + s)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(z))), pa.array(np.full(len(each), n)), pa.array(deviation, pa.int64()).take(pa.array(each)),
                     pa.array(z.ravel()), pa.array(np.tile(explained, len(z))), pa.array(np.full(len(each), error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error.

    The fit list is all rows of `entries`, repeated rows and rows without vec_id included. Components whose eigenvalue can't be told from zero
    (rounding, times the number of dimensions, of the largest) have no direction and are left out: with one vector, or copies of one, no rows
    come back. Components of equal eigenvalues come in any order, and as any basis of their space. deviation is null where it doesn't fit
    a long. An empty table gives no rows; other columns are not read.
    """
    rows = small_batches(entries(vectors))
    x, none = rows.select("x"), vectors.sparkSession.createDataFrame([], _WHITE)
    totals = _totals(x, _sums)
    n, d = totals.pop((-1, -1), 0), len(totals)
    if not n:
        return none
    sums = np.array([totals[i, -1] for i in range(d)], object)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    scatter = _totals(x, _scatter(centre))
    rest = [int(s) - n * c for s, c in zip(sums, centre, strict=True)]  # sums of the centred entries
    covariance = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            covariance[i, j] = covariance[j, i] = (n * scatter[i, j] - rest[i] * rest[j]) / (n * n)
    values, axes = jacobi(covariance)
    k = int((values[:components] > d * np.finfo(np.float64).eps * values[0]).sum())
    if not k:
        return none
    matrix = axes[:, :k] / np.sqrt(values[:k])
    explained = (values[:k] / np.trace(covariance)).tolist()
    error = _identity_error(x, n, sums, matrix)
    return rows.mapInArrow(_rows(n, sums, matrix, explained, error), _WHITE)
