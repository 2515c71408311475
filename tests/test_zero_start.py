"""Series that begin with a price of zero: fits and untrimmed stores against their SQL."""

from __future__ import annotations

import math

import pytest

import __spark_entry__ as entry
from tests.test_queries import _rows

duckdb = pytest.importorskip("duckdb")
NAMES = [
    "p01_trend",
    "p02_rising",
    "p03_top10",
    "s04_replace_one_pair",
    "s04_store_merge",
    "s04_store_roundtrip",
    "s04_whole_store",
    "s05_odd_ids_stored",
    "t15_stored_coverage",
]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """25 days of ten users; users 7 and 8 start with zeros on days 1 to 6 or on day 16, by type."""
    folder = tmp_path_factory.mktemp("events")
    zero = "(user_id IN (7, 8) AND (day < 6 OR event_type = 'view' AND day < 17))"
    duckdb.sql(
        f"""COPY (SELECT row_number() OVER (ORDER BY day, user_id, event_type) AS event_id,
          TIMESTAMP '2024-01-01 12:00:00' + day * INTERVAL 1 DAY AS ts, user_id, event_type,
          CASE WHEN {zero} THEN 0.0 ELSE 200 + (user_id - 4) * day + day % 3 END::DOUBLE AS value, '' AS props
        FROM range(25) a(day), range(10) b(user_id), (VALUES ('click'), ('view')) c(event_type)
        WHERE NOT (event_type = 'view' AND day < 16))
        TO '{folder}/events.parquet' (FORMAT parquet)"""
    )
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_equal_to_the_sql(spark, events, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{events}/events.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, events).toPandas()
    columns = sorted(want.columns)
    left, right = _rows(got, columns), _rows(want, columns)
    assert sorted(got.columns) == columns and len(left) == len(right) > 0
    for a, b in zip(left, right):
        for x, y in zip(a, b):
            assert math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) if isinstance(x, float) and isinstance(y, float) else x == y, (a, b)
