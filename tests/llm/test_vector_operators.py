"""Vector searches against brute force."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import one_bit, voronoi

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, code string, cell string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 24)).astype(np.float32)
    x[300:600] = x[300]  # one vector of a third of all rows
    x[700:720] = 0
    out = [(i, v.tolist(), 1, "a", "b", "c") for i, v in enumerate(x)]
    bad = [None, [], [None] * 24, [float("nan")] * 24, [float("inf")] * 24, [1.0] * 5]
    out += [(1000 + 20 * i, v, None, None, None, None) for i, v in enumerate(bad)]
    out += [(None, [1.0] * 24, 1, "a", "b", "c"), out[5], out[20]]
    return out


def brute(rows, whole, k=20):
    used = []
    for i, v, *_ in rows:
        if i is None or v is None or len(v) != 24 or any(c is None or not math.isfinite(c) for c in v):
            continue
        v = np.array(v, float)
        if not whole and not v.any():
            continue
        used.append((i, np.floor(64 * v) if whole else v))
    ids = np.array([i for i, _ in used])
    x = np.stack([v for _, v in used])
    out = {}
    for q in sorted({i for i in ids.tolist() if i % 20 == 0}):
        scores = (x * x[ids.tolist().index(q)]).sum(1)
        other = np.flatnonzero(ids != q)
        chosen = other[np.lexsort((ids[other], -scores[other]))[:k]]
        out[q] = list(zip(ids[chosen].tolist(), scores[chosen].tolist()))
    return out


def answers(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("block", [8192, 100])
def test_voronoi_join_is_exact(spark, rows, monkeypatch, block):
    monkeypatch.setattr(voronoi, "BLOCK_ROWS", block)
    monkeypatch.setattr(voronoi, "BLOCK_QUERIES", max(10, block // 8))
    table = spark.createDataFrame(rows, SCHEMA)
    assert answers(voronoi.knn_join(table, F.col("vec_id") % 20 == 0, pivots=16)) == brute(rows, True)


@pytest.mark.parametrize("block", [8192, 100])
def test_one_bit_recall_and_scores(spark, rows, monkeypatch, block):
    monkeypatch.setattr(one_bit, "BLOCK_ROWS", block)
    monkeypatch.setattr(one_bit, "BLOCK_QUERIES", max(10, block // 8))
    table = spark.createDataFrame(rows, SCHEMA)
    got, want = answers(one_bit.search(table, F.col("vec_id") % 20 == 0)), brute(rows, False)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q in want:
        exact = dict(want[q])
        assert all(math.isclose(s, exact[i], rel_tol=1e-12, abs_tol=1e-12) for i, s in got[q] if i in exact)


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(500, 64)), rng.normal(size=(20, 64))
    centre = x.mean(0)
    codes, length, fit = one_bit.encode(x, centre, 7)
    about, width = one_bit.estimate(codes, length, fit, q, 7, 3.0)
    error = np.abs(about - q @ (x - centre).T)
    assert codes.shape == (500, 8) and (error <= width).mean() > 0.99
    assert np.abs((about - q @ (x - centre).T).mean()) < 0.2


def test_few_or_no_candidates(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [0.5, 0.5])], "vec_id long, embedding array<float>")
    is_query = F.col("vec_id") % 20 == 0
    for search in (one_bit.search, voronoi.knn_join):
        assert {q: [i for i, _ in v] for q, v in answers(search(few, is_query)).items()} == {0: [1, 20], 20: [0, 1]}
        assert search(few.filter("false"), is_query).count() == 0
        assert search(few.filter("vec_id = 0"), is_query).count() == 0
