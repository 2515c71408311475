"""Rows that share an id with a query are no candidates, and do not raise its bound."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import voronoi


@pytest.mark.parametrize("repeats", [2, 30])
def test_an_id_with_many_equal_rows_keeps_its_neighbours(spark, repeats):
    rng = np.random.default_rng(6)
    others = [(i, [-50.0, float(y)]) for i, y in enumerate(rng.integers(-40, 40, 200), 1)]
    rows = [(0, [100.0, 0.0])] * repeats + others
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = voronoi.knn_join(table, F.col("vec_id") == 0, scale=1, pivots=16).orderBy("rank").collect()
    want = sorted((-100 * 50, -(-i)) for i, _ in others)[:20]
    assert [(r.score, r.vec_id) for r in got] == want
