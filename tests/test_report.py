from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import magnitude_label, reason_bucket
from tidemark.operators import report as rp

SCHEMA = "date date, rank int, coin_id string, volume double, weight double, price double"


@pytest.fixture(scope="module")
def members():
    """Random membership with missing dates, across a month and a year boundary."""
    rng, out = random.Random(5), {}
    for n in range(40):
        if rng.random() < 0.25:
            continue
        chosen = rng.sample("abcdefgh", 4)
        out[date(2023, 12, 10) + timedelta(days=n)] = chosen
    return out


@pytest.fixture(scope="module")
def composition(spark, members):
    rows = [(d, r, c, 10.0 * r, 0.25, 1.0) for d, coins in members.items() for r, c in enumerate(coins, 1)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_changes_rebuild_each_day_from_the_previous(composition, members):
    changes = {}
    for r in rp.membership_changes(composition).collect():
        changes.setdefault(r["date"], {"added": set(), "removed": set()})[r["change"]].add(r["coin_id"])
    dates = sorted(members)
    assert dates[0] not in changes
    for before, today in zip(dates, dates[1:]):
        change = changes.get(today, {"added": set(), "removed": set()})
        assert (set(members[before]) - change["removed"]) | change["added"] == set(members[today])
        assert change["added"].isdisjoint(members[before]) and change["removed"] <= set(members[before])


def test_summary_text(composition, members):
    rows = {r["date"]: r for r in rp.membership_summary(composition).collect()}
    dates = sorted(members)
    assert rows[dates[0]]["added"] == rows[dates[0]]["removed"] == "N/A (first day)"
    for before, today in zip(dates, dates[1:]):
        added = [c.upper() for c in members[today] if c not in members[before]]
        removed = [c.upper() for c in members[before] if c not in members[today]]
        assert rows[today]["previous_date"] == before
        assert rows[today]["added"] == (", ".join(added) or "None")
        assert rows[today]["removed"] == (", ".join(removed) or "None")


def test_months_grid_totals_and_carry(composition, members):
    months = {r["month"]: (r["month_label"], r["is_latest"]) for r in rp.months(composition).collect()}
    assert months == {"2023_12": ("Dec 2023", False), "2024_01": ("Jan 2024", True)}
    grid = {r["year"]: (r["m12"], r["m01"], r["m02"]) for r in rp.availability_grid(composition).collect()}
    assert grid == {2023: (True, False, False), 2024: (False, True, False)}
    totals = {(r["member_count"], r["listed_volume"]) for r in rp.day_totals(composition).collect()}
    assert totals == {(4, 100.0)}
    carried = [r["date"] for r in rp.previous_dates(composition).collect() if r["carried_over"]]
    assert carried == [min(d for d in members if d.year == 2024)]


def test_month_rows_and_files(spark, composition, members, tmp_path):
    first = min(members)
    index = composition.select("date").distinct().filter(F.col("date") != first).withColumn("index_price", F.lit(2.0))
    rows = rp.month_rows(composition, index)
    got = rows.filter((F.col("date") == first) & (F.col("rank") == 1)).first()
    assert got["index_price"] is None and got["weight_pct"] == 25.0 and got["coin_id"] == members[first][0].upper()
    path = str(tmp_path / "months")
    rp.write_month_rows(rows, path)
    back = spark.read.json(path)
    assert back.count() == rows.count()
    assert {r["month"] for r in back.select("month").distinct().collect()} == {"2023_12", "2024_01"}


def test_status_and_counters(spark):
    accepted = spark.createDataFrame(
        [(1, "ETH", "ETH", "Ethereum", 2.5e9), (2, "x", "X", "X", 1.0), (3, "sol", "SOL", "Solana", None)],
        "position long, id string, symbol string, name string, market_cap double",
    )
    coverage = spark.createDataFrame(
        [("eth", date(2020, 1, 1), date(2020, 2, 1), 32), ("sol", date(2021, 1, 1), date(2021, 1, 1), 1)],
        "coin_id string, start_date date, end_date date, days long",
    )
    rows = {r["position"]: r for r in rp.status_rows(accepted, coverage).collect()}
    assert set(rows) == {1, 3} and rows[1]["market_cap_label"] == "$2.50B" and rows[3]["market_cap_label"] == "$0"
    skipped = spark.createDataFrame([("wbtc",)], "coin_id string")
    counted = rp.report_counters(accepted, skipped, coverage).first().asDict()
    assert counted == {"total": 4, "with_data": 2, "skipped": 1, "accepted": 3}


def test_magnitudes_print_like_the_binary_value(spark):
    amounts = [0.0, 0.5, 1.5, 999_999.4, 1e6, 1.005e6, 1.125e6, 2.675e6, 999_999_999.0, 1e9, 1.115e9, 1.2345e13, -5.0, 1234567.0]
    df = spark.createDataFrame([(a,) for a in amounts], "a double").select("a", magnitude_label(F.col("a")).alias("t"))

    def expected(a: float) -> str:
        if a >= 1e9:
            return f"${a / 1e9:.2f}B"
        return f"${a / 1e6:.2f}M" if a >= 1e6 else f"${a:,.0f}"

    assert {r["a"]: r["t"] for r in df.collect()} == {a: expected(a) for a in amounts}


def test_reason_buckets(spark):
    cases = {
        "BTC derivative": "btc",
        "Bitcoin (base currency)": "btc",
        "Stablecoin": "stablecoin",
        "Insufficient historical data (starts 2024-02-01)": "history",
        "No Historical prices": "history",
        "Wrapped/Staked/Bridged token": "wrapped",
        "No price data available": "wrapped",
    }
    df = spark.createDataFrame([(c,) for c in cases], "r string").select("r", reason_bucket(F.col("r")).alias("b"))
    assert {r["r"]: r["b"] for r in df.collect()} == cases


def test_dataset_status(spark):
    prices = spark.createDataFrame([("a", "BTC"), ("a", "USD"), ("a", "USD"), ("b", "BTC")], "coin_id string, quote string")
    index = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 5),)], "date date")
    row = rp.dataset_status(prices, index).first().asDict()
    assert row == {
        "n_entities": 2,
        "n_pairs": 3,
        "index_days": 2,
        "first_date": date(2024, 1, 1),
        "last_date": date(2024, 1, 5),
    }
