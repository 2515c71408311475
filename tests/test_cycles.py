from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cycles as cy

CYCLES = cy.cycle_windows([date(2020, 1, 10), date(2020, 1, 20)], before=5, after=7)


def test_default_windows():
    got = [(c.number, c.start, c.end) for c in cy.DEFAULT_CYCLES]
    assert got == [
        (1, date(2011, 5, 28), date(2015, 4, 27)),
        (2, date(2015, 1, 6), date(2018, 12, 6)),
        (3, date(2018, 11, 8), date(2022, 10, 8)),
        (4, date(2022, 10, 17), date(2026, 9, 16)),
    ]


@pytest.fixture(scope="module")
def series(spark):
    # No row on the second anchor: the next available day is its base.
    days = [d for d in range(1, 31) if d != 20]
    return spark.createDataFrame([(date(2020, 1, d), float(d)) for d in days], "date date, close double")


def test_slice_duplicates_overlaps_without_shuffle(series, plan_of):
    sliced = cy.cycle_slice(series, CYCLES)
    got = {(r["cycle"], r["date"].day): r["days_from_anchor"] for r in sliced.collect()}
    assert {d for c, d in got if c == 1} == set(range(5, 18))
    assert {d for c, d in got if c == 2} == set(range(15, 28)) - {20}
    assert got[1, 16] == 6 and got[2, 16] == -4
    plan = plan_of(sliced)
    assert "Exchange" not in plan and "Join" not in plan


def test_normalised_at_the_next_available_day(series):
    rows = cy.base_cycles(series, CYCLES).collect()
    at = {(r["cycle"], r["days_from_anchor"]): r["normalised"] for r in rows}
    assert at[1, 0] == 1.0 and at[2, 1] == 1.0 and at[2, -5] == 15 / 21
    assert cy.base_cycles(series, CYCLES, normalised=False).count() == len(rows)


@pytest.mark.parametrize("first", [None, 0.0, -1.0, float("nan")])
def test_no_series_when_the_first_row_is_not_positive(spark, series, first):
    bad = series.withColumn("close", F.when(F.col("date") == date(2020, 1, 10), F.lit(first)).otherwise(F.col("close")))
    bad = bad.withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    assert {r["cycle"] for r in cy.base_cycles(bad, CYCLES).collect()} == {2}


def test_no_row_after_the_anchor(series):
    early = series.filter(F.col("date") < date(2020, 1, 20))
    assert {r["cycle"] for r in cy.base_cycles(early, CYCLES).collect()} == {1}


def test_conversion_keeps_days_without_a_rate(spark, series):
    index = series.withColumnRenamed("close", "index_price")
    base = series.filter(F.col("date") != date(2020, 1, 16)).withColumn("close", F.lit(2.0))
    got = {r["date"].day: r["index_converted"] for r in cy.convert_quote(index, base).collect()}
    assert got[15] == 30.0 and got[16] is None and len(got) == 29


def test_dual_skips_the_first_cycle(spark, series):
    index = series.withColumnRenamed("close", "index_price")
    base = series.select("date", F.col("close").alias("close"))
    rows = cy.index_cycles_dual(index, base, CYCLES).collect()
    assert {(r["quote"], r["cycle"]) for r in rows} == {("BTC", 2), ("USD", 2)}
    usd = {r["days_from_anchor"]: r["normalised"] for r in rows if r["quote"] == "USD"}
    assert usd[1] == 1.0 and usd[7] == (27 * 27) / (21 * 21)


def test_leading_members_skip_holes_in_the_ranks(spark):
    comp = spark.createDataFrame(
        [(date(2020, 1, 16), r, c) for r, c in [(1, "a"), (3, "b"), (4, "c"), (7, "d")]], "date date, rank int, coin_id string"
    )
    assert cy.top_members_label(comp, 3).first()["top_members"] == "A, B, C"


def test_labels(spark):
    dates = spark.createDataFrame([(date(2020, 1, d),) for d in (1, 6, 16, 27)], "date date")
    both = {r["date"].day: r["cycle_label"] for r in cy.label_dates(dates, CYCLES, first_cycle=1).collect()}
    assert both == {1: "", 6: "C1: Day -4", 16: "C1: Day 6 | C2: Day -4", 27: "C2: Day 7"}
    shown = {r["date"].day: r["cycle_label"] for r in cy.label_dates(dates, CYCLES).collect()}
    assert shown[16] == "C2: Day -4" and shown[6] == ""


def test_dimension(spark):
    rows = cy.cycle_dimension(spark).collect()
    assert [(r["cycle"], r["anchor_date"]) for r in rows][3] == (4, date(2024, 4, 19))
    assert rows[0]["end_date"] - rows[0]["start_date"] == timedelta(days=1430)
