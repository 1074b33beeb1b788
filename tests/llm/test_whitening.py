"""Whitening against numpy and exact arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest

from mistveil.llm.whitening import jacobi, whiten
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, n string, component int"


def plain(vectors, components=32):
    """vectors: lists of entries. n, deviations, and the covariance from exact fractions with numpy's eigensolver."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    deviation = [sum((n * r[i] - sums[i]) ** 2 for i in range(d)) for r in x]
    y = np.array([[float(Fraction(n * r[i] - sums[i], n)) for i in range(d)] for r in x])
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return n, deviation, y @ (v / np.sqrt(e)), e / np.trace(y.T @ y / n)


def check(got, ids, vectors):
    n, deviation, white, explained = plain(vectors)
    k = white.shape[1]
    assert len(got) == n * k and {r.n for r in got} == {n}
    z, exact = {}, {}
    for r in got:
        z[r.vec_id, r.component] = r.whitened
        exact[r.vec_id] = r.deviation
        assert abs(r.explained - explained[r.component - 1]) <= 1e-6 * explained[r.component - 1] and r.identity_error <= 1e-4
    assert exact == dict(zip(ids, deviation, strict=True))
    found = np.array([[z[i, c + 1] for c in range(k)] for i in ids])
    signs = np.sign((found * white).sum(axis=0))
    assert np.allclose(found, white * signs, atol=1e-5)
    assert np.abs(found.T @ found / n - np.eye(k)).max() <= 1e-4


@pytest.mark.parametrize("d", [3, 40])
def test_against_numpy(spark, d):
    rng = np.random.default_rng(d)
    x = (rng.normal(size=(400, d)) * np.geomspace(20, 0.2, d)) @ np.linalg.qr(rng.normal(size=(d, d)))[0] + rng.normal(size=d) * 100
    x[100:230] = x[7]  # a third are copies
    good = [(i, [float(c) for c in np.float32(v)], "x", 1) for i, v in enumerate(x)]
    bad = [(1000, None, "x", 1), (1001, [], "x", 1), (1002, [None, *[1.0] * (d - 1)], "x", 1), (1003, [float("nan")] * d, "x", 1), (1004, [float("-inf")] * d, "x", 1), (1005, [1.0] * (d + 1), "x", 1)]
    got = whiten(spark.createDataFrame(good + bad, SCHEMA).repartition(5)).collect()
    check(got, [r[0] for r in good], [r[1] for r in good])


def test_given_embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    given = [(r.vec_id, r.embedding) for r in rows.collect()]
    check(whiten(rows).collect(), [i for i, _ in given], [v for _, v in given])


def test_small_eigenvalues():
    """Graded matrices: the smallest eigenvalues come out to nearly all digits, where the size of the largest would drown them."""
    rng = np.random.default_rng(2)
    scale = np.array([10.0**-i for i in range(12)])
    core = np.eye(12) + 0.1 * (lambda m: m + m.T)(rng.uniform(-0.3, 0.3, size=(12, 12)))
    e, v = jacobi(core * scale[:, None] * scale)
    exact = np.array(_eigenvalues_by_bisection(core, scale))
    assert np.all(np.abs(e - exact) <= 1e-10 * exact) and np.all(np.diff(e) <= 0)
    assert np.abs(v.T @ v - np.eye(12)).max() < 1e-13


def _eigenvalues_by_bisection(core, scale):
    """Falling eigenvalues of the graded matrix, by the signs of exact LDL' pivots."""
    a = [[Fraction(float(core[i, j] * scale[i] * scale[j])) for j in range(len(scale))] for i in range(len(scale))]

    def below(x):
        m, count = [[a[i][j] - (x if i == j else 0) for j in range(len(a))] for i in range(len(a))], 0
        for p in range(len(m)):
            count += m[p][p] < 0
            for i in range(p + 1, len(m)):
                f = (m[i][p] / m[p][p]).limit_denominator(10**60)
                for j in range(p + 1, len(m)):
                    m[i][j] -= f * m[p][j]
        return count

    out = []
    for rank in range(len(a)):
        low, high = -40.0, 2.0  # log10
        for _ in range(48):
            middle = (low + high) / 2
            if below(Fraction(10.0**middle)) > rank:
                high = middle
            else:
                low = middle
        out.append(10.0**low)
    return out[::-1]


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whiten(empty).count() == 0 and whiten(empty).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0], "", 0)], SCHEMA)).count() == 0  # no spread
    assert whiten(spark.createDataFrame([(i, [1.0, 2.0], "", 0) for i in range(9)], SCHEMA)).count() == 0
    flat = [(i if i else None, [float(i), 2.0 * i, 5.0], "", 0) for i in range(4)]  # one direction alone; a row without id
    got = whiten(spark.createDataFrame(flat, SCHEMA)).collect()
    assert {r.component for r in got} == {1} and sorted(r.vec_id is None for r in got) == [False, False, False, True] and abs(got[0].explained - 1) < 1e-12
    large = [(i, [2.0**40 * (i % 3), 2.0**39 * i], "", 0) for i in range(6)]  # products beyond 2^53, deviation beyond a long
    got = whiten(spark.createDataFrame(large, SCHEMA)).collect()
    assert len(got) == 12 and max(r.identity_error for r in got) < 1e-4 and any(r.deviation is None for r in got)
