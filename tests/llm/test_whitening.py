"""Whitening against exact fractions and numpy's eigenvalues."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest

from roleledger.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n long, vector string"


def brute(rows):
    """Exact integers of usable rows, and the covariance rounded once."""
    x = [[floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows]
    n, size = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(size)]
    deviation = [sum((n * v - s) ** 2 for v, s in zip(r, sums)) for r in x]
    off = [[Fraction(n * v - s, n) for v, s in zip(r, sums)] for r in x]
    cov = np.array([[float(sum(r[i] * r[j] for r in off) / n) for j in range(size)] for i in range(size)])
    return n, deviation, np.array([[float(v) for v in r] for r in off]), cov


def checked(found, rows, most=32):
    n, deviation, off, cov = brute(rows)
    values = np.linalg.eigvalsh(cov)[::-1]
    rank = min(most, int((values > values[0] * 1e-9).sum()))
    assert len(found) == n * rank
    by = {}
    for r in found:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, rank + 1))
    for k, own in by.items():
        assert {r["n"] for r in own} == {n}
        assert sorted(r["deviation"] for r in own) == sorted(deviation)
        assert all(abs(r["explained"] - values[k - 1] / values.sum()) <= 1e-9 * values[k - 1] / values.sum() + 1e-15 for r in own)
        assert all(r["identity_error"] <= 1e-9 for r in own)
    return by, off, cov


@pytest.mark.parametrize("shape", [(60, 5), (40, 33), (9, 12), (200, 1)])
def test_against_fractions(spark, shape):
    pick = np.random.default_rng(shape[0])
    vectors = (pick.normal(size=shape) * pick.uniform(0.1, 3, shape[1]) + pick.normal(size=shape[1])).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    table = spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], SCHEMA).repartition(5)
    by, off, cov = checked(whitening.whitened(table).collect(), rows)
    values, axes = np.linalg.eigh(cov)
    for k, own in by.items():
        points = np.array([r["whitened"] for r in sorted(own, key=lambda r: r["vec_id"])])
        wanted = off @ axes[:, -k] / np.sqrt(values[-k])
        assert min(np.abs(points - wanted).max(), np.abs(points + wanted).max()) < 1e-6


def test_odd_rows(spark):
    good = [(1, [0.5, 1.0, -2.0]), (1, [0.5, 1.0, -2.0]), (None, [3.0, 0.0, 0.25]), (4, [1.0, 1.0, 1.0]), (5, [0.0, 2.0, 0.0])]
    bad = [(6, None), (7, []), (8, [1.0, None, 2.0]), (9, [float("nan"), 0.0, 1.0]), (10, [1.0, float("inf"), 0.0]), (11, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, "clash", 7, None) for r in good + bad], SCHEMA)
    found = whitening.whitened(table, most=2).collect()
    checked(found, good, most=2)
    assert {r["vec_id"] for r in found} == {1, 4, 5, None}
    assert whitening.whitened(table.where("vec_id > 5")).count() == 2 * 0
    assert whitening.whitened(table.where("false")).collect() == []
    assert whitening.whitened(table.where("vec_id = 1")).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, [1e30]), (2, [-1e30]), (3, [0.0])], "vec_id long, embedding array<double>")).count() == 3


def test_scatter_is_exact():
    rows = np.array([[3, -5], [1 << 30, 7], [1 << 35, -(1 << 35)]])
    wide = rows.astype(object)
    assert (whitening.scatter(rows) == wide.T.dot(wide)).all()
    assert (whitening.scatter(rows[:1]) == wide[:1].T.dot(wide[:1])).all()


def test_small_eigenvalues_keep_their_digits():
    pick = np.random.default_rng(1)
    axes, _ = np.linalg.qr(pick.normal(size=(24, 24)))
    wanted = 10.0 ** np.arange(6, -6, -0.5)
    values, found = whitening.one_sided_jacobi(whitening.pivoted_cholesky(axes @ np.diag(wanted) @ axes.T))
    assert np.abs(values / wanted - 1)[:16].max() < 1e-6
    assert np.abs(found.T @ found - np.eye(24)).max() < 1e-12


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").limit(120).collect()]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    checked(whitening.whitened(table).collect(), rows)
    whole = queries.op13_whitening(spark, sf)
    assert whole.count() == 500 * 32 and whole.where("identity_error > 1e-9 or deviation is null").count() == 0
