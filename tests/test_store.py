"""The store under repeated writes, the landing under faults, the daily run."""

from __future__ import annotations

import json
import os
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import index as ix
from tidemark.operators import maintain as mt
from tidemark.operators import rolling, trend
from tidemark.operators.classify import append_short_history, with_history_before, without_history_before
from tidemark.plans import history, market
from tidemark.schema import PRICES
from tidemark.sources import payloads, prices, results
from tidemark.streaming.landing import deliver_landing

FIRST = date(2024, 1, 1)
NAN = float("nan")


def day(n):
    return FIRST + timedelta(days=n)


def table(spark, rows):
    """(coin, quote, day number, close[, volume])"""
    full = [(c, q, day(n), 1.0, 1.0, 1.0, v, 1.0, (rest or [5.0])[0]) for c, q, n, v, *rest in rows]
    return spark.createDataFrame(full, PRICES)


def stored(spark, path):
    rows = prices.scan_prices(spark, path).collect()
    return sorted((r["coin_id"], r["quote"], (r["date"] - FIRST).days, r["close"]) for r in rows)


def state_is_true(spark, path):
    kept = sorted(map(str, prices.series_state(spark, path).collect()))
    return kept == sorted(map(str, prices._state_of(prices.scan_prices(spark, path)).collect()))


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("eth", "BTC", n, 1.0 + n) for n in range(5)] + [("sol", "BTC", n, 2.0 + n) for n in range(40)]
    prices.write_prices(table(spark, rows), path)
    return path


def test_a_store_is_created_once_and_then_merged(spark, store):
    with pytest.raises(FileExistsError):
        prices.write_prices(table(spark, [("eth", "BTC", 9, 1.0)]), store)
    before = stored(spark, store)
    prices.merge_into_store(spark, store, table(spark, [("eth", "BTC", 9, 1.0)]))
    assert stored(spark, store) == sorted([*before, ("eth", "BTC", 9, 1.0)]) and state_is_true(spark, store)
    prices.merge_into_store(spark, store, table(spark, [("eth", "BTC", 60, 1.0)]), replace=True)
    assert stored(spark, store) == sorted([r for r in before if r[0] == "sol"] + [("eth", "BTC", 60, 1.0)])
    assert state_is_true(spark, store)


@pytest.mark.parametrize(
    "delta",
    [
        [("eth", "BTC", 0, 0.0)],  # the first positive close is overwritten by none
        [("eth", "BTC", 0, None), ("eth", "BTC", 1, NAN)],
        [("eth", "BTC", 0, 7.0, None)],  # the first volume is
        [("eth", "BTC", -40, 0.0), ("eth", "BTC", -35, 3.0)],  # older days
        [("new", "USD", 3, 0.0), ("new", "USD", 4, 1.0), ("sol", "BTC", 70, 1.0)],
        [("zero", "BTC", 2, 0.0)],
    ],
)
def test_state_and_rows_equal_those_of_a_merge_over_everything(spark, store, delta):
    base = prices.scan_prices(spark, store).collect()
    fresh = prices.series_rows(table(spark, delta))
    whole = mt.trim_leading(mt.upsert_keep_last(spark.createDataFrame(base, PRICES), fresh)).collect()
    want = sorted((r["coin_id"], r["quote"], (r["date"] - FIRST).days, r["close"]) for r in whole)
    for _ in range(2):
        prices.merge_into_store(spark, store, table(spark, delta))
        assert stored(spark, store) == want and state_is_true(spark, store)


def test_a_series_of_zeros_that_gets_a_price_is_trimmed(spark, store):
    prices.merge_into_store(spark, store, table(spark, [("z", "BTC", n, 0.0) for n in (1, 2, 33)]))
    assert state_is_true(spark, store)
    prices.merge_into_store(spark, store, table(spark, [("z", "BTC", 70, 4.0)]))
    assert [r for r in stored(spark, store) if r[0] == "z"] == [("z", "BTC", 70, 4.0)] and state_is_true(spark, store)


def test_an_increment_reads_its_months_and_the_state_only(spark, store, monkeypatch):
    seen = []
    original = prices._partitions

    def spy(rows, wanted):
        seen.append(sorted((r["quote"], r["month"]) for r in wanted))
        return original(rows, wanted)

    def no_scan(*_, **__):
        raise AssertionError("the whole store was scanned")

    monkeypatch.setattr(prices, "_partitions", spy)
    monkeypatch.setattr(prices, "scan_prices", no_scan)
    prices.merge_into_store(spark, store, table(spark, [("sol", "BTC", 41, 9.0), ("eth", "BTC", 42, 9.0)]))
    assert seen == [[("BTC", "2024-02")]]


def test_a_daily_index_reads_its_window_and_the_state_only(spark, tmp_path, plan_of, monkeypatch):
    path = str(tmp_path / "store")
    prices.write_prices(table(spark, [(c, "BTC", n, 1.0, 10.0 * k) for k, c in enumerate("abcd", 1) for n in range(90)]), path)
    bounds = []
    original = market.scan_prices

    def spy(session, where, quote, start, end):
        bounds.append((start, end))
        return original(session, where, quote, start, end)

    monkeypatch.setattr(market, "scan_prices", spy)
    result = market.build_index(spark, path, top_n=3, window=7, start=day(85))
    assert bounds == [(day(79), None)] and result.index.count() == 5
    assert result.stats.first()["coins_processed"] == 4


def test_daily_runs_leave_the_result_of_a_full_run(spark, tmp_path):
    path = str(tmp_path / "store")
    data = [(c, "BTC", n, 1.0 + k + n % 7, 10.0 * ((k * n) % 5 + 1)) for k, c in enumerate("abcde", 1) for n in range(70)]
    prices.write_prices(table(spark, data), path)
    full, daily = [(str(tmp_path / f"{n}-i"), str(tmp_path / f"{n}-c")) for n in ("full", "daily")]
    market.build_index(spark, path, *full, top_n=3, window=5)
    market.build_index(spark, path, *daily, top_n=3, window=5, end=day(28))
    for start, end in ((29, 29), (25, 45), (46, None)):
        market.build_index(spark, path, *daily, top_n=3, window=5, start=day(start), end=end and day(end))
    for read, i in ((results.read_index, 0), (results.read_composition, 1)):
        a, b = (sorted(map(str, read(spark, p[i]).collect())) for p in (full, daily))
        assert a == b and len(a) > 60


def test_a_range_that_became_empty_leaves_no_composition(spark, tmp_path):
    from tidemark.schema import COMPOSITION

    path = str(tmp_path / "c")
    rows = spark.createDataFrame([(day(n), 1, "eth", 1.0, 1.0, 1.0) for n in (0, 40)], COMPOSITION)
    results.write_composition(rows, path)
    results.write_composition_range(rows.limit(0), path, day(31), None)
    assert [r["date"] for r in results.read_composition(spark, path).collect()] == [day(0)]
    assert not (tmp_path / "c" / "month=2024-02").exists()


def test_ids_that_become_equal_are_one_series(spark, tmp_path):
    path = str(tmp_path / "store")
    prices.write_prices(table(spark, [("a/b", "btc", 0, 0.0), ("a/b", "BTC", 1, 5.0), ("a:b", "BTC", 1, 6.0), ("a:b", "BTC", 2, 7.0)]), path)
    assert stored(spark, path) == [("a_b", "BTC", 1, 5.0), ("a_b", "BTC", 2, 7.0)]


def test_lookups_use_the_stored_form_of_an_id(spark, tmp_path):
    path = str(tmp_path / "store")
    prices.write_prices(table(spark, [("usdc.e", "BTC", n, 1.0) for n in range(3)]), path)
    entities = spark.createDataFrame([("usdc.e", "U", "n"), ("$x", "X", "n")], "id string, symbol string, name string")
    plan = {r["coin_id"]: r["mode"] for r in history.plan_fetch(spark, entities, path, day(3), ["BTC"]).collect()}
    assert plan == {"usdc.e": "current", "$x": "full"}
    held = prices.scan_prices(spark, path)
    assert [r["id"] for r in with_history_before(entities, held, day(1)).collect()] == ["usdc.e"]
    recent = without_history_before(entities, held, day(0))
    assert {r["id"] for r in recent.collect()} == {"usdc.e", "$x"}
    nothing = spark.createDataFrame([], "coin_id string, name string, symbol string, reason string, url string")
    reasons = {r["coin_id"]: r["reason"] for r in append_short_history(nothing, recent, held).collect()}
    assert "2024-01-01" in reasons["usdc.e"] and "2024" not in reasons["$x"]


def test_nan_is_missing_everywhere(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = table(spark, [("a", "BTC", 0, NAN), ("a", "BTC", 1, 2.0), ("a", "BTC", 2, NAN), ("a", "BTC", 3, 4.0)])
    assert [r["close"] for r in mt.trim_leading(rows.filter("day(date) < 3")).collect()] == [2.0]
    prices.write_prices(rows, path)
    assert stored(spark, path) == [("a", "BTC", 1, 2.0), ("a", "BTC", 2, None), ("a", "BTC", 3, 4.0)]
    fit = trend.linear_trend(rows, day(0), min_points=2).first()
    assert fit["n_points"] == 2 and fit["a"] == pytest.approx(0.5) and fit["r2"] == pytest.approx(1.0)


def test_trend_is_relative_to_the_start_of_the_series(spark):
    # 2 on the first day, then 4, 6, 8 from the fit's start on: relative to 2 the slope is 1 per day.
    rows = table(spark, [("a", "BTC", 0, 2.0), ("a", "BTC", 10, 4.0), ("a", "BTC", 11, 6.0), ("a", "BTC", 12, 8.0)])
    fit = trend.linear_trend(rows, day(10), min_points=3).first()
    assert (fit["a"], fit["b"], fit["n_points"]) == (pytest.approx(1.0), pytest.approx(2.0), 3)
    inside = trend.linear_trend(rows, day(10), min_points=3, base="window").first()
    assert (inside["a"], inside["b"]) == (pytest.approx(0.5), pytest.approx(1.0))


def page(folder, name, records, cut=None):
    body = [{"time": 1704067200 + n * 86400, "close": c, "volumeto": 5} for n, c in records]
    (folder / name).write_text(json.dumps({"Response": "Success", "Data": {"Data": body}})[:cut])


def test_faulty_pages_are_listed_in_batch_and_stream(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    page(landing, "eth-btc-0000.json", [(0, 1.0), (1, 2.0)])
    page(landing, "sol-btc-0000.json", [(0, 1.0), (1, 2.0)], cut=60)
    page(landing, "stray.json", [(0, 1.0)])
    (landing / "bad-btc-0000.json").write_text(json.dumps({"Response": "Error", "Message": "no"}))
    want = {("bad", "no"), ("sol", "Not valid JSON"), ("stray.json", "File name is not that of a history page")}
    store = str(tmp_path / "a")
    failed = history.ingest_landing(spark, str(landing), store)
    assert {(r["coin_id"], r["Message"]) for r in failed.collect()} == want
    assert {r[0] for r in stored(spark, store)} == {"eth"}
    store = str(tmp_path / "b")
    deliver_landing(spark, str(landing), store, "faults", checkpoint=str(tmp_path / "ck")).awaitTermination()
    side = spark.read.parquet(f"{store}/_failed/faults")
    assert {(r["coin_id"], r["Message"]) for r in side.collect()} == want
    assert {r[0] for r in stored(spark, store)} == {"eth"}


def test_the_newest_fetch_wins_in_one_batch_as_in_two(spark, tmp_path):
    folders = [tmp_path / f for f in ("both", "first", "second")]
    for f in folders:
        f.mkdir()
    for f in folders[:2]:
        page(f, "eth-btc@20240105-0000.json", [(1, 1.0), (2, 4.0)])
        page(f, "eth-btc@20240105-0001.json", [(0, 1.0), (1, 99.0)])
    for f in (folders[0], folders[2]):
        page(f, "eth-btc@20240106-0003.json", [(2, 40.0), (3, 5.0)])
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    history.ingest_landing(spark, str(folders[0]), one)
    history.ingest_landing(spark, str(folders[1]), two)
    history.ingest_landing(spark, str(folders[2]), two)
    assert stored(spark, one) == stored(spark, two) == [("eth", "BTC", n, c) for n, c in enumerate([1.0, 1.0, 40.0, 5.0])]
    stream = str(tmp_path / "stream")
    deliver_landing(spark, str(folders[0]), stream, "backlog", checkpoint=str(tmp_path / "ck")).awaitTermination()
    assert stored(spark, stream) == stored(spark, one)
    # Without labels the day on which a file was written tells fetches apart.
    plain = tmp_path / "plain"
    plain.mkdir()
    page(plain, "eth-btc-0000.json", [(2, 4.0)])
    page(plain, "eth-btc-0002.json", [(2, 40.0)])
    os.utime(plain / "eth-btc-0000.json", (1704067200, 1704067200))
    history.ingest_landing(spark, str(plain), str(tmp_path / "c"))
    assert stored(spark, str(tmp_path / "c")) == [("eth", "BTC", 2, 40.0)]


def test_skipped_pair_files_are_listed(spark, tmp_path):
    import pandas as pd

    folder = tmp_path / "files"
    folder.mkdir()
    index = pd.date_range("2024-01-01", periods=2, name="date")
    pd.DataFrame({"close": [1.0, 2.0], "volume_to": 1.0}, index=index).to_parquet(folder / "eth-btc.parquet")
    pd.DataFrame({"close": ["1", "x"]}, index=index).to_parquet(folder / "odd-btc.parquet")
    (folder / "bad-btc.parquet").write_bytes(b"no parquet")
    skipped = history.import_pair_files(spark, str(folder), str(tmp_path / "store"))
    assert [r["file"] for r in skipped.collect()] == ["bad-btc.parquet"]
    assert stored(spark, str(tmp_path / "store")) == [
        ("eth", "BTC", 0, 1.0), ("eth", "BTC", 1, 2.0), ("odd", "BTC", 0, 1.0), ("odd", "BTC", 1, None),
    ]


@pytest.mark.parametrize("threshold", ["1000", "-1", "10"])
def test_top_rows_do_not_depend_on_the_threshold(spark, threshold, plan_of):
    rows = spark.range(3000).select(
        F.concat(F.lit("c"), "id").alias("coin_id"), F.lit(FIRST).alias("date"), (F.col("id") % 50).cast("double").alias("v")
    )
    order = sorted((-(i % 50), f"c{i}") for i in range(3000))
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", threshold)
    try:
        for n in (50, 2000):
            top = rolling.top_per_date(rows, n, "v")
            assert [c for _, c in order[:n]] == [r["coin_id"] for r in top.orderBy("rank").collect()]
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_coverage_keeps_quotes_apart(spark):
    rows = table(spark, [("a", "BTC", 0, 1.0), ("a", "USD", 0, 1.0), ("a", "USD", 4, 1.0)])
    assert {(r["quote"], r["days"]) for r in ix.coverage(rows).collect()} == {("BTC", 1), ("USD", 2)}
    assert [(r["coin_id"], r["days"]) for r in ix.coverage(rows, quote="usd").collect()] == [("a", 2)]
