"""Series whose slopes are zero or equal: signs and ties of the fits against their SQL."""

from __future__ import annotations

import math

import pytest

import __spark_entry__ as entry
from tests.test_queries import _rows

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """28 days in many small files: users 0 to 299 have one price each, and 300 on are copies of three series."""
    folder = tmp_path_factory.mktemp("events")
    steps = "[3.37, 0.1, 7.77, 20.03, 5.55, 41.9, 13.13, 8.01, 2.2, 9.99, 11.17, 0.73, 6.61, 17.3]"
    value = f"""CASE WHEN user_id < 300 THEN 0.1 * (1 + user_id % 97)
      ELSE {steps}[1 + day % 14] * (1 + user_id % 3) + day END"""
    for part in range(7):
        path = f"{folder}/events.parquet"
        (folder / "events.parquet").mkdir(exist_ok=True)
        duckdb.sql(
            f"""COPY (SELECT day * 1000 + user_id AS event_id, TIMESTAMP '2024-01-02 12:00:00' + to_days(day) AS ts, user_id, 'view' AS event_type,
              round({value}, 2)::DOUBLE AS value, '' AS props
            FROM (SELECT a.r::INTEGER AS day, b.r AS user_id FROM range(28) a(r), range(400) b(r)) WHERE hash(day, user_id) % 7 = {part})
            TO '{path}/{part}.parquet' (FORMAT parquet)"""
        )
    return str(folder)


@pytest.fixture(scope="module")
def many_partitions(spark):
    """The days of a series come from several partitions, as in larger tables."""
    settings = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["p01_trend", "p02_rising", "p03_top10"])
def test_equal_to_the_sql(spark, events, many_partitions, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{events}/events.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, events).toPandas()
    columns = sorted(want.columns)
    left, right = _rows(got, columns), _rows(want, columns)
    assert sorted(got.columns) == columns and len(left) == len(right) > 0
    for a, b in zip(left, right):
        for x, y in zip(a, b):
            assert math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) if isinstance(x, float) and isinstance(y, float) else x == y, (a, b)
