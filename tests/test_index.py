from __future__ import annotations

import math
import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import index as ix
from tidemark.operators import rolling
from tidemark.operators.rolling import Columns

SCHEMA = "coin_id string, date date, close double, volume_to double"
FIRST = date(2024, 1, 1)


def day(n: int) -> date:
    return FIRST + timedelta(days=n)


def random_prices(seed: int, entities: int = 8, days: int = 25):
    """Series with gaps, missing volumes, missing prices and repeated volumes (ties)."""
    rng = random.Random(seed)
    rows = []
    for e in range(entities):
        begin = rng.randrange(6)
        for n in range(begin, days):
            if rng.random() < 0.08:
                continue
            volume = None if rng.random() < 0.04 else float(rng.randrange(0, 5) * 7)
            price = None if rng.random() < 0.1 else round(rng.uniform(0.5, 9), 3)
            rows.append((f"c{e}", day(n), price, volume))
    return rows


def brute_force(rows, top_n, window, strict=False, min_members=3):
    """The index and composition by definition, one day and entity at a time."""
    price = {(c, d): p for c, d, p, _ in rows}
    volume = {(c, d): v for c, d, _, v in rows if v is not None}
    coins = sorted({c for c, *_ in rows})
    firsts = {c: min((d for cc, d in volume if cc == c), default=None) for c in coins}
    low, high = min(r[1] for r in rows), max(r[1] for r in rows)
    index, comp = {}, {}
    for n in range((high - low).days + 1):
        today = low + timedelta(days=n)
        scored = []
        for c in coins:
            past = [volume.get((c, today - timedelta(days=k))) for k in range(window)]
            if any(v is None for v in past):
                continue
            warm = today <= firsts[c] + timedelta(days=window - 1)
            p = None if warm else price.get((c, today))
            if strict and p is None:
                continue
            scored.append((-sum(past) / window, c, p))
        top = sorted(scored)[:top_n]
        total = sum(-s for s, _, _ in top)
        if len(top) < min_members or total == 0:
            continue
        index[today] = (sum(-s * p for s, _, p in top if p is not None) / total, total, len(top))
        for rank, (s, c, p) in enumerate(top, start=1):
            if p is not None:
                comp[today, c] = (rank, -s, -s / total, p)
    return index, comp


@pytest.fixture(scope="module")
def sample(spark):
    series = {
        "eth": ([0.05, 0.052, 0.051, 0.053, 0.054], [10000, 11000, 10500, 12000, 11500]),
        "sol": ([0.003, 0.0031, 0.0029, 0.0032, 0.0033], [2000, 2100, 1900, 2200, 2300]),
        "ada": ([0.00002, 0.000021, 0.000019, 0.000022, 0.000023], [500, 550, 450, 600, 580]),
    }
    rows = [(c, day(n), p[n], float(v[n])) for c, (p, v) in series.items() for n in range(5)]
    return spark.createDataFrame(rows, SCHEMA)


def test_single_day_weighted_mean(sample):
    row = ix.single_day_index(sample, day(0), 3).first()
    expected = (0.05 * 10000 + 0.003 * 2000 + 0.00002 * 500) / 12500
    assert abs(row["index_price"] - expected) < 1e-10
    assert (row["total_volume"], row["coin_count"]) == (12500.0, 3)
    members = {r["coin_id"]: (r["rank"], r["weight"]) for r in ix.single_day_members(sample, day(0), 2).collect()}
    assert members == {"eth": (1, 10000 / 12000), "sol": (2, 2000 / 12000)}


def test_single_day_needs_three_entities_before_the_cut(sample):
    assert ix.single_day_index(sample.filter("coin_id <> 'ada'"), day(0), 3).isEmpty()
    assert ix.single_day_index(sample, day(0), 1).first()["coin_count"] == 1


def test_pipeline_starts_with_zero_when_all_start_together(sample):
    rows = {r["date"]: r for r in ix.weighted_index(sample, 50, 2).collect()}
    assert sorted(rows) == [day(1), day(2), day(3), day(4)]
    assert rows[day(1)]["index_price"] == 0.0
    assert all(r["coin_count"] == 3 for r in rows.values())
    dates = {r["date"] for r in ix.composition(sample, 50, 2).collect()}
    assert dates == {day(2), day(3), day(4)}
    strict = {r["date"]: r["index_price"] for r in ix.weighted_index(sample, 50, 2, price_mask="strict").collect()}
    assert sorted(strict) == [day(2), day(3), day(4)]
    sma = {"eth": 10750.0, "sol": 2000.0, "ada": 500.0}
    expected = (0.051 * sma["eth"] + 0.0029 * sma["sol"] + 0.000019 * sma["ada"]) / sum(sma.values())
    assert math.isclose(strict[day(2)], expected, rel_tol=1e-12)


def test_unknown_price_mask(sample):
    with pytest.raises(ValueError):
        ix.weighted_index(sample, price_mask="other")


@pytest.mark.parametrize(("seed", "window", "top_n", "strict"), [(1, 3, 3, False), (2, 4, 5, True), (3, 1, 8, False)])
def test_index_equals_definition(spark, seed, window, top_n, strict):
    rows = random_prices(seed)
    prices = spark.createDataFrame(rows, SCHEMA)
    mask = "strict" if strict else "reference"
    index, comp = brute_force(rows, top_n, window, strict)
    got = {r["date"]: r for r in ix.weighted_index(prices, top_n, window, price_mask=mask).collect()}
    assert set(got) == set(index)
    for when, (value, total, count) in index.items():
        assert math.isclose(got[when]["index_price"], value, rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(got[when]["total_volume"], total, rel_tol=1e-9)
        assert got[when]["coin_count"] == count
    members = {(r["date"], r["coin_id"]): r for r in ix.composition(prices, top_n, window, price_mask=mask).collect()}
    assert set(members) == set(comp)
    weights = defaultdict(float)
    for key, (rank, volume, weight, price) in comp.items():
        assert members[key]["rank"] == rank and members[key]["price"] == price
        assert math.isclose(members[key]["weight"], weight, rel_tol=1e-9, abs_tol=1e-12)
        weights[key[0]] += members[key]["weight"]
    assert max(weights.values()) <= 1 + 1e-9


def test_smoothing_only_a_recent_slice_gives_the_same_values(spark):
    rows = random_prices(7, days=40)
    prices = spark.createDataFrame(rows, SCHEMA)
    whole = ix.ranked_members(prices, 4, 5).filter(F.col("date").between(day(20), day(33)))
    part = ix.ranked_members(prices, 4, 5, start=day(20), end=day(33))
    assert sorted(map(tuple, part.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_later_days_do_not_change_earlier_values(spark):
    rows = random_prices(11, days=30)
    early = [r for r in rows if r[1] <= day(20)]
    before = {r["date"]: r["index_price"] for r in ix.weighted_index(spark.createDataFrame(early, SCHEMA), 4, 3).collect()}
    after = {r["date"]: r["index_price"] for r in ix.weighted_index(spark.createDataFrame(rows, SCHEMA), 4, 3).collect()}
    assert all(math.isclose(after[k], v, rel_tol=1e-12, abs_tol=1e-12) for k, v in before.items())


def test_rank_above_the_group_limit_threshold(spark, plan_of):
    rows = spark.range(3000).select(
        F.concat(F.lit("c"), "id").alias("coin_id"),
        F.lit(day(0)).alias("date"),
        (F.col("id") % 50).cast("double").alias("v"),
    )
    order = sorted(((-(i % 50), f"c{i}") for i in range(3000)))
    for n in (999, 1500):
        top = rolling.top_per_date(rows, n, "v")
        assert [c for _, c in order[:n]] == [r["coin_id"] for r in top.orderBy("rank").collect()]


def test_ties_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([("b", day(0), 1.0), ("a", day(0), 1.0), ("c", day(0), 2.0)], "coin_id string, date date, v double")
    ranks = {r["coin_id"]: r["rank"] for r in rolling.top_per_date(rows, 3, "v").collect()}
    assert ranks == {"c": 1, "a": 2, "b": 3}


def test_nan_counts_as_missing(spark):
    nan = float("nan")
    rows = [(c, day(n), 1.0, nan if (c, n) == ("b", 2) else 5.0) for c in "abc" for n in range(4)]
    index = {r["date"]: r["coin_count"] for r in ix.weighted_index(spark.createDataFrame(rows, SCHEMA), 5, 1, min_members=1).collect()}
    assert index == {day(0): 3, day(1): 3, day(2): 2, day(3): 3}


def test_alignment_and_coverage(spark):
    prices = spark.createDataFrame(
        [("a", day(1), 1.0, 1.0), ("a", day(3), 3.0, 3.0), ("b", day(0), 5.0, 5.0), ("b", day(4), 6.0, 6.0)], SCHEMA
    )
    aligned = {(r["coin_id"], r["date"]): r["close"] for r in rolling.align_calendar(prices).collect()}
    assert len(aligned) == 10
    assert [aligned["a", day(n)] for n in range(5)] == [None, 1.0, None, 3.0, None]
    assert [aligned["b", day(n)] for n in range(5)] == [5.0, None, None, None, 6.0]
    covered = {r["coin_id"]: (r["start_date"], r["end_date"], r["days"]) for r in ix.coverage(prices).collect()}
    assert covered == {"a": (day(1), day(3), 2), "b": (day(0), day(4), 2)}


def test_column_names_are_parameters(spark, sample):
    renamed = sample.toDF("who", "when", "px", "vol")
    named = ix.weighted_index(renamed, 3, 2, columns=Columns("who", "when", "px", "vol"))
    assert sorted(map(tuple, named.collect())) == sorted(map(tuple, ix.weighted_index(sample, 3, 2).collect()))


def test_two_shuffles_and_a_limit_before_the_second(sample, plan_of):
    plan = plan_of(ix.weighted_index(sample, 10, 3))
    assert plan.count("Exchange") == 2
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning(date")
    assert plan.count("WindowGroupLimit") == 2
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_composition_adds_no_shuffle(sample, plan_of):
    assert plan_of(ix.composition(sample, 10, 3)).count("Exchange") == 2


def test_result_bundle(spark, sample):
    result = ix.compute_index(sample, 3, 2)
    stats = result.stats.first()
    assert (stats["coins_processed"], stats["n_days"], stats["avg_coins"]) == (3, 4, 3.0)
    assert (stats["first_date"], stats["last_date"]) == (day(1), day(4))
    assert [r["date"] for r in ix.latest(result.index, 2).collect()] == [day(4), day(3)]
    assert [r["coin_id"] for r in ix.composition_at(result.composition, day(3)).collect()] == ["eth", "sol", "ada"]
    assert [r["date"] for r in ix.entity_history(result.composition, "sol").collect()] == [day(2), day(3), day(4)]
    assert ix.in_range(result.index, day(2), day(3)).count() == 2
