"""Every registered query against its SQL on the supplied tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from catalogue import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if value is None or str(value) in ("NaT", "<NA>", "nan"):
        return None
    if hasattr(value, "year"):
        return str(value)[:10]
    if isinstance(value, (str, bytes)):
        return str(value)
    if str(value) in ("True", "False"):
        return str(value)
    return float(value)


def _rows(frame, columns):
    return sorted((tuple(_plain(v) for v in row) for row in frame[columns].itertuples(index=False)), key=repr)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, oracle, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    want = oracle.execute(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    left, right = _rows(got, columns), _rows(want, columns)
    assert len(left) == len(right)
    for a, b in zip(left, right):
        for x, y in zip(a, b):
            same = math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) if isinstance(x, float) and isinstance(y, float) else x == y
            assert same, (a, b)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["date", "index_price", "total_volume", "coin_count"] and df.count() > 0


@pytest.mark.parametrize("name", ["t05_daily_topn", "c04_normalised", "p01_trend", "i02_upsert_keep_last", "p08_relative", "f13_append",
                                  "c07_asof_backward", "c07_convert_asof", "c02_interval_join", "r03_running_number"])
def test_plans_stay_native_without_products(spark, plan_of, name):
    plan = plan_of(entry.queries()[name](spark, SF_DIR))
    assert "Python" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
