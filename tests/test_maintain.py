from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import maintain as mt

SCHEMA = "coin_id string, quote string, date date, close double"


def d(day: int) -> date:
    return date(2024, 1, day)


def rows_of(df):
    return sorted((r["coin_id"], r["quote"], r["date"].day, r["close"]) for r in df.collect())


def test_trim_drops_leading_zeros_only(spark):
    prices = spark.createDataFrame(
        [("a", "BTC", d(1), 0.0), ("a", "BTC", d(2), None), ("a", "BTC", d(3), 1.0), ("a", "BTC", d(4), 0.0)]
        + [("a", "BTC", d(5), 2.0)]
        + [("z", "BTC", d(1), 0.0), ("z", "BTC", d(2), 0.0)]
        + [("a", "USD", d(1), 5.0)],
        SCHEMA,
    )
    assert rows_of(mt.trim_leading(prices)) == [
        ("a", "BTC", 3, 1.0),
        ("a", "BTC", 4, 0.0),
        ("a", "BTC", 5, 2.0),
        ("a", "USD", 1, 5.0),
        ("z", "BTC", 1, 0.0),
        ("z", "BTC", 2, 0.0),
    ]


def test_upsert_newest_wins_and_is_idempotent(spark):
    base = spark.createDataFrame([("a", "BTC", d(1), 1.0), ("a", "BTC", d(2), 2.0), ("b", "BTC", d(1), 9.0)], SCHEMA)
    delta = spark.createDataFrame([("a", "BTC", d(2), 20.0), ("a", "BTC", d(3), 30.0)], SCHEMA)
    once = mt.upsert_keep_last(base, delta)
    expected = [("a", "BTC", 1, 1.0), ("a", "BTC", 2, 20.0), ("a", "BTC", 3, 30.0), ("b", "BTC", 1, 9.0)]
    assert rows_of(once) == expected
    assert rows_of(mt.upsert_keep_last(once, delta)) == expected
    assert rows_of(mt.upsert_keep_last(base, delta.limit(0))) == rows_of(base)


def test_upsert_orders_repeated_keys_of_the_delta(spark):
    base = spark.createDataFrame([], SCHEMA)
    delta = spark.createDataFrame([("a", "BTC", d(1), 1.0), ("a", "BTC", d(1), 3.0), ("a", "BTC", d(1), 2.0)], SCHEMA)
    assert rows_of(mt.upsert_keep_last(base, delta, delta_order=[F.col("close").desc()])) == [("a", "BTC", 1, 3.0)]


def test_copies_are_reduced_before_the_shuffle(spark, plan_of):
    # One key holds nearly all rows.
    rows = spark.range(20_000).select(
        F.when(F.col("id") < 19_000, "hot").otherwise(F.col("id").cast("string")).alias("coin_id"),
        F.lit("BTC").alias("quote"),
        F.lit(d(1)).alias("date"),
        (20_000 - F.col("id")).alias("page"),
        F.lit(0).alias("pos"),
    )
    kept = mt.dedup_pages(rows)
    plan = plan_of(kept)
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    found = {r["coin_id"]: r["page"] for r in kept.filter("coin_id in ('hot', '19500')").collect()}
    assert found == {"hot": 20_000 - 18_999, "19500": 500}


def test_legacy_rows_count_only_without_a_pair_series(spark):
    rows = spark.createDataFrame(
        [("a", "BTC", d(1), 1.0, True), ("a", "BTC", d(2), 2.0, False), ("b", "BTC", d(1), 3.0, True)]
        + [("b", "USD", d(1), 4.0, False)],
        SCHEMA + ", is_legacy boolean",
    )
    assert rows_of(mt.prefer_pair_rows(rows)) == [("a", "BTC", 2, 2.0), ("b", "BTC", 1, 3.0), ("b", "USD", 1, 4.0)]
    store = rows.filter("not is_legacy").drop("is_legacy")
    legacy = rows.filter("is_legacy").select("coin_id", "date", "close")
    migrated = mt.migrate_legacy(store, legacy)
    assert rows_of(migrated) == [("a", "BTC", 2, 2.0), ("b", "BTC", 1, 3.0), ("b", "USD", 1, 4.0)]


@pytest.mark.parametrize("incremental", [True, False])
def test_fetch_plan_modes(spark, incremental):
    entities = spark.createDataFrame([("eth", "eth"), ("new", None)], "id string, symbol string")
    last = spark.createDataFrame(
        [("eth", "BTC", d(10)), ("eth", "USD", d(19))], "coin_id string, quote string, last_date date"
    )
    plan = mt.fetch_plan(entities, last, as_of=d(20), incremental=incremental)
    got = {(r["coin_id"], r["quote"]): (r["symbol"], r["start_date"], r["end_date"], r["mode"]) for r in plan.collect()}
    full = date(2011, 5, 28)
    assert got[("new", "USD")] == ("NEW", full, d(19), "full")
    if incremental:
        assert got[("eth", "BTC")] == ("ETH", d(11), d(19), "incremental")
        assert got[("eth", "USD")] == ("ETH", None, d(19), "current")
    else:
        assert {v[3] for v in got.values()} == {"full"}


def test_fetch_plan_cap(spark):
    entities = spark.createDataFrame([("eth", "eth")], "id string, symbol string")
    last = spark.createDataFrame([("eth", "BTC", d(10))], "coin_id string, quote string, last_date date")
    row = mt.fetch_plan(entities, last, as_of=d(20), quotes=["btc"], cap=d(10)).first()
    assert (row["mode"], row["end_date"]) == ("current", d(10))


def test_refresh_equals_upsert_then_trim(spark, plan_of):
    zeros = [("z", "BTC", d(n), 0.0) for n in (1, 2, 3)]
    base = spark.createDataFrame(zeros + [("a", "BTC", d(n), float(n)) for n in (1, 2, 3)] + [("o", "BTC", d(1), 0.0)], SCHEMA)
    delta = spark.createDataFrame(
        [("z", "BTC", d(3), 5.0), ("z", "BTC", d(4), 0.0), ("a", "BTC", d(1), 0.0), ("a", "BTC", d(2), None)]
        + [("n", "USD", d(1), 0.0), ("n", "USD", d(2), 1.0)],
        SCHEMA,
    )
    both = mt.refresh(base, delta)
    assert plan_of(both).count("Exchange") == 1

    def text(df):
        return sorted(map(str, df.collect()))

    assert text(both) == text(mt.trim_leading(mt.upsert_keep_last(base, delta)))
    assert rows_of(both.filter("coin_id in ('z', 'a', 'o')")) == [
        ("a", "BTC", 3, 3.0),
        ("o", "BTC", 1, 0.0),
        ("z", "BTC", 3, 5.0),
        ("z", "BTC", 4, 0.0),
    ]
