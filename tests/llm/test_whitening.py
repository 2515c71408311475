"""Whitening against a dense eigendecomposition, and the solver on operators of several kinds."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component int, n long, x string"


@pytest.mark.parametrize("dim, wanted, kind", [(64, 32, "decay"), (300, 10, "low rank"), (1, 32, "decay"), (5, 3, "repeated"), (400, 20, "flat")])
def test_eigenpairs_reach_double_precision(dim, wanted, kind):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    values = {"decay": 0.9 ** np.arange(dim), "repeated": np.ones(dim), "flat": 1 + rng.random(dim), "low rank": np.r_[np.arange(30, 0, -1), np.zeros(270)]}[kind]
    a = (q * values[:dim]) @ q.T
    a = (a + a.T) / 2
    found, vectors = whitening.jacobi_davidson(lambda b: a @ b, dim, wanted)
    k = min(wanted, dim)
    assert np.allclose(found, np.sort(values)[::-1][:k], rtol=0, atol=1e-13 * values.max())
    assert np.abs(a @ vectors - vectors * found).max() < 1e-13 * values.max()
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13


def test_minres_solves():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(20, 20))
    a, b = a + a.T, rng.normal(size=(20, 3))
    shifts = np.array([0.5, -3.0, 100.0])
    t = whitening.minres(lambda v: a @ v, shifts, lambda v: v, b, 200, 1e-13)
    assert np.allclose(a @ t - t * shifts, b, atol=1e-7)


def _check(rows, vectors, components):
    x = np.floor(64 * vectors.astype(np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > 1e-10 * e[0]).sum()))
    assert len(rows) == n * k
    by_key = {(r["vec_id"], r["component"]): r for r in rows}
    deviation = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(1)
    for i in range(n):
        for c in range(1, k + 1):
            r = by_key[i, c]
            assert r["n"] == n and r["deviation"] == deviation[i] and r["identity_error"] < 1e-8
            assert abs(r["explained"] - e[c - 1] / np.trace(v)) < 1e-10
    got = np.array([[by_key[i, c]["whitened"] for c in range(1, k + 1)] for i in range(n)])
    want = centred @ u[:, :k] / np.sqrt(e[:k])
    sign = np.sign((got * want).sum(0))
    assert np.abs(got - want * sign).max() < 1e-6


@pytest.mark.parametrize("fan_in, dim, components", [(64, 12, 32), (2, 40, 6)])
def test_equal_to_brute_force(spark, monkeypatch, fan_in, dim, components):
    monkeypatch.setattr(whitening, "FAN_IN", fan_in)
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(500, dim)) * np.linspace(2, 0.3, dim)).astype(np.float32)
    vectors[100:250] = vectors[0]  # a large group of equal vectors
    rows = [(i, v.tolist(), 1, 2, "x") for i, v in enumerate(vectors)]
    odd = [None, [], [1.0] * (dim - 1), [float("nan")] * dim, [None] * dim, [float("inf")] * dim, [1e30] * dim]
    table = spark.createDataFrame(rows + [(1000, v, None, None, None) for v in odd], SCHEMA).repartition(9)
    _check(whitening.whiten(table, components).collect(), vectors, components)


def test_tables_without_spread(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], 1, 1, "x") for i in range(5)], SCHEMA)
    assert whitening.whiten(same).count() == 0
    line = spark.createDataFrame([(None, [float(i), 2.0 * i], 1, 1, "x") for i in range(5)], SCHEMA)
    rows = whitening.whiten(line).collect()
    assert len(rows) == 5 and {r["component"] for r in rows} == {1} and all(r["vec_id"] is None for r in rows)


def test_large_numbers_stay_exact():
    x = np.array([[1 << 39, 5], [3, 1 << 20]])
    assert whitening._deviation(x >> 18, 3, np.array([7, 11], object)).tolist() == [(3 * (1 << 21) - 7) ** 2 + 11**2, 7**2 + 1]
    with pytest.raises(OverflowError):
        whitening._deviation(x, 1 << 20, np.array([0, 0], object))
