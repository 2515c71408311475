"""A merge that ends at any of its steps, run again with the same rows, leaves the right store; summaries stay true."""

from __future__ import annotations

from datetime import date, timedelta

import pytest

from tidemark.operators import trend
from tidemark.operators.index import coverage
from tidemark.plans import market
from tidemark.schema import PRICES
from tidemark.sources import prices

FIRST = date(2024, 1, 1)


class Cut(Exception):
    pass


def table(spark, rows):
    full = [(c, q, FIRST + timedelta(days=n), 1.0, 1.0, 1.0, v, 1.0, 5.0) for c, q, n, v in rows]
    return spark.createDataFrame(full, PRICES)


STORED = (
    [("eth", "BTC", n, 1.0 + n) for n in range(0, 70)]
    + [("low", "BTC", n, 0.0) for n in range(0, 50)]  # no positive close so far: kept whole
    + [("sol", "BTC", n, 2.0 + n) for n in range(20, 40)]
)
DELTA = (
    [("eth", "BTC", n, 9.0) for n in range(65, 75)]
    + [("low", "BTC", n, 3.0) for n in range(60, 65)]  # a start at last: two months of zeros go
    + [("sol", "BTC", 20, 0.0), ("new", "BTC", 33, 1.0)]  # the start is overwritten and moves on
)


def contents(spark, path):
    rows = prices.scan_prices(spark, path).collect()
    return sorted((r["coin_id"], r["quote"], (r["date"] - FIRST).days, r["close"]) for r in rows)


def side_tables_are_true(spark, path):
    scanned = prices.scan_prices(spark, path)
    state = sorted(map(str, prices.series_state(spark, path).collect())) == sorted(map(str, prices._state_of(scanned).collect()))
    kept, made = prices.month_summaries(spark, path), prices.summarise(scanned)
    columns = ["coin_id", "quote", "month", "days", "n", "first", "last", "first_date", "last_date"]
    months = sorted(map(str, kept.select(columns).collect())) == sorted(map(str, made.select(columns).collect()))
    return state and months


def cut_after(monkeypatch, step):
    """The merge fails right behind, or in the middle of, its change number ``step``."""
    done = {"n": 0}
    delete, overwrite, summaries = prices.delete_folder, prices._overwrite_partitions, prices._write_summaries

    def counted(change, half=None):
        def run(*args):
            done["n"] += 1
            if done["n"] == step:
                (half or change)(*args)
                raise Cut
            return change(*args)

        return run

    def half_of(rows, path):
        overwrite(rows.filter("month = '2024-02'"), path)

    monkeypatch.setattr(prices, "delete_folder", counted(delete))
    monkeypatch.setattr(prices, "_overwrite_partitions", counted(overwrite, half_of))
    monkeypatch.setattr(prices, "_write_summaries", counted(summaries, lambda *a: None))


@pytest.fixture(scope="module")
def whole_merge(spark, tmp_path_factory):
    found = {}
    for replace in (False, True):
        path = str(tmp_path_factory.mktemp("whole") / "store")
        prices.write_prices(table(spark, STORED), path)
        prices.merge_into_store(spark, path, table(spark, DELTA), replace)
        found[replace] = contents(spark, path)
    return found


def test_the_whole_merge(whole_merge):
    got = whole_merge[False]
    assert [r for r in got if r[0] == "low"] == [("low", "BTC", n, 3.0) for n in range(60, 65)]
    assert [r[2] for r in got if r[0] == "sol"] == list(range(21, 40))
    assert [r[3] for r in got if r[0] == "eth"] == [1.0 + n for n in range(65)] + [9.0] * 10


@pytest.mark.parametrize("step, replace", [*[(n, False) for n in range(1, 8)], (2, True), (5, True)])
def test_a_cut_merge_is_mended_by_the_next(spark, tmp_path, monkeypatch, whole_merge, step, replace):
    path = str(tmp_path / "store")
    prices.write_prices(table(spark, STORED), path)
    with monkeypatch.context() as patched:
        cut_after(patched, step)
        try:
            prices.merge_into_store(spark, path, table(spark, DELTA), replace)
        except Cut:
            pass
        else:
            pytest.skip("the merge has fewer changes")
    prices.merge_into_store(spark, path, table(spark, DELTA), replace)
    assert contents(spark, path) == whole_merge[replace]
    assert side_tables_are_true(spark, path)


def test_a_half_written_state_does_not_count(spark, tmp_path):
    path = str(tmp_path / "store")
    prices.write_prices(table(spark, STORED), path)
    prices.delete_folder(spark, f"{path}/_series")
    (tmp_path / "store" / "_series" / "_temporary" / "0").mkdir(parents=True)
    prices.merge_into_store(spark, path, table(spark, [("eth", "BTC", 71, 4.0)]))
    assert len([r for r in contents(spark, path) if r[0] == "eth"]) == 71
    assert side_tables_are_true(spark, path)


def test_missing_summaries_are_made_from_their_months_only(spark, tmp_path):
    path = str(tmp_path / "store")
    prices.write_prices(table(spark, STORED), path)
    assert prices.partitions_of(spark, path, ("quote", "month")) == prices.partitions_of(spark, f"{path}/_months", ("quote", "month"))
    prices.delete_folder(spark, f"{path}/_months/quote=BTC/month=2024-02")
    assert side_tables_are_true(spark, path)


@pytest.mark.parametrize("start, end", [((2024, 1, 1), None), ((2024, 2, 1), (2024, 2, 29)), ((2024, 1, 9), (2024, 3, 4)), ((2024, 2, 3), (2024, 2, 20)), ((2024, 2, 1), (2024, 2, 20)), ((2024, 1, 31), None)])
@pytest.mark.parametrize("base", ["series", "window"])
def test_stored_trend_equals_trend_of_rows(spark, fitted_store, start, end, base):
    path = fitted_store
    start, end = date(*start), end and date(*end)
    got = {r["coin_id"]: tuple(r)[1:] for r in market.stored_trend(spark, path, "btc", start, end, 1, base).collect()}
    want = {r["coin_id"]: tuple(r)[1:] for r in trend.linear_trend(prices.scan_prices(spark, path, "btc"), start, end, 1, base=base).collect()}
    assert got.keys() == want.keys() and got
    for coin in got:
        for a, b in zip(got[coin], want[coin]):
            assert (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-8 * max(1, abs(b))), coin


@pytest.fixture(scope="module")
def fitted_store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fits") / "store")
    rows = [(f"c{c}", "BTC", n, 1e6 + ((n * 37 + c) % 101) * 0.5 + c * n) for c in range(4) for n in range(c, 80)]
    rows += [("gap", "BTC", n, None if n % 3 else 5.0 + n) for n in range(60)] + [("one", "BTC", 40, 2.0), ("flat", "BTC", 39, 2.0), ("flat", "BTC", 41, 2.0)]
    prices.write_prices(table(spark, rows), path)
    return path


def test_trend_of_whole_months_reads_no_price_file(spark, tmp_path, plan_of):
    path = str(tmp_path / "store")
    prices.write_prices(table(spark, STORED), path)
    files = market.stored_trend(spark, path, "BTC", date(2024, 1, 1)).inputFiles()
    assert files and all("/_months/" in f for f in files)
    got = sorted(map(tuple, market.stored_coverage(spark, path, "btc").collect()))
    assert got == sorted(map(tuple, coverage(prices.scan_prices(spark, path), quote="btc").select("coin_id", "start_date", "end_date", "days").collect()))
