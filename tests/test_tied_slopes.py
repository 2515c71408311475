"""Series that differ by a shift of days only: their slopes tie but for rounding, which decides which of them are the top ten."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from catalogue import trend

duckdb = pytest.importorskip("duckdb")

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """Six copies of the events, each with other users and a day later than the one before."""
    folder = tmp_path_factory.mktemp("shifted")
    duckdb.sql(
        f"""COPY (SELECT event_id + c * 100000 AS event_id, ts + to_days(c::INTEGER) AS ts, user_id + c * 1500 AS user_id,
          event_type, value, props FROM '{SF}/events.parquet', range(6) r(c)) TO '{folder}/events.parquet' (FORMAT parquet)"""
    )
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return str(folder), con


def test_top_ten_are_those_of_the_sql(spark, shifted):
    folder, con = shifted
    want = con.execute(f"SELECT coin_id FROM ({entry.oracle_sql()['p03_top10']})").fetchall()
    got = entry.queries()["p03_top10"](spark, folder).select("coin_id").collect()
    assert sorted(r.coin_id for r in got) == sorted(r[0] for r in want)


def test_slopes_are_rounded_as_in_the_sql(spark, shifted):
    folder, con = shifted
    sql = trend._sql_trend(trend.SQL_EV, trend._EV_START, trend._EV_POINTS)
    want = dict(con.execute(f"SELECT coin_id, a FROM ({sql})").fetchall())
    got = {r.coin_id: r.a for r in trend._events_trend(spark, folder).collect()}
    assert got == want and len(got) == 9000
