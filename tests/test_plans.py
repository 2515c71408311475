from __future__ import annotations

import json
import uuid
from datetime import date, timedelta

import pytest

from tidemark.operators.cycles import cycle_windows
from tidemark.plans import history, market, universe
from tidemark.schema import PRICES
from tidemark.sources import lists, prices, results
from tidemark.streaming.landing import deliver_landing

FIRST = date(2024, 1, 1)


def day(n: int) -> date:
    return FIRST + timedelta(days=n)


def rows(spark, coins, days):
    data = [(c, "BTC", day(n), 1.0, 1.0, 1.0, k + n + 1.0, 1.0, 100.0 * (k + 1)) for k, c in enumerate(coins) for n in range(days)]
    return spark.createDataFrame(data, PRICES)


def page(folder, name, records):
    body = [{"time": 1704067200 + n * 86400, "open": 1, "high": 1, "low": 1, "close": c, "volumefrom": 1, "volumeto": 5} for n, c in records]
    (folder / name).write_text(json.dumps({"Response": "Success", "Data": {"Data": body}}))


def closes(spark, store):
    return {(r["coin_id"], (r["date"] - FIRST).days): r["close"] for r in prices.scan_prices(spark, store).collect()}


def test_universe(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def coin(symbol, name):
        return {"CoinInfo": {"Name": symbol, "FullName": name}, "RAW": {"USD": {"MKTCAP": 1}}}

    data = [coin("BTC", "Bitcoin"), coin("USDT", "Tether"), coin("ETH", "Ethereum"), coin("WBTC", "Wrapped Bitcoin")]
    (tmp_path / "in" / "ranking-0.json").write_text(json.dumps({"Data": data}))
    counters = universe.refresh_universe(spark, str(tmp_path / "in"), str(tmp_path / "acc"), str(tmp_path / "skip"))
    assert counters.first().asDict() == {"fetched": 4, "filtered": 2, "accepted": 2}
    kept = lists.read_entities(spark, str(tmp_path / "acc")).collect()
    assert sorted((r["position"], r["id"], r["market_cap_rank"]) for r in kept) == [(1, "btc", 1), (2, "eth", 3)]
    assert {r["coin_id"] for r in lists.read_skipped(spark, str(tmp_path / "skip")).collect()} == {"usdt", "wbtc"}
    plan = history.plan_fetch(spark, lists.read_entities(spark, str(tmp_path / "acc")), None, date(2024, 2, 1))
    assert {r["mode"] for r in plan.collect()} == {"full"} and plan.count() == 4


def test_landing_to_store_in_batch_and_as_a_stream(spark, tmp_path):
    batch, landing, store = tmp_path / "batch", tmp_path / "landing", str(tmp_path / "store")
    batch.mkdir(), landing.mkdir()
    name = f"test-{uuid.uuid4().hex}"
    page(batch, "eth-btc-0000.json", [(2, 3.0), (3, 4.0)])
    page(batch, "eth-btc-0001.json", [(0, 0.0), (1, 2.0), (2, 99.0)])
    (batch / "bad-btc-0000.json").write_text(json.dumps({"Response": "Error", "Message": "no"}))
    failed = history.ingest_landing(spark, str(batch), store)
    assert failed.count() == 1
    assert closes(spark, store) == {("eth", 1): 2.0, ("eth", 2): 3.0, ("eth", 3): 4.0}

    page(landing, "eth-btc-0002.json", [(3, 40.0), (4, 5.0)])
    deliver_landing(spark, str(landing), store, name).awaitTermination()
    expected = {("eth", 1): 2.0, ("eth", 2): 3.0, ("eth", 3): 40.0, ("eth", 4): 5.0}
    assert closes(spark, store) == expected
    # Nothing new: nothing is merged again.
    deliver_landing(spark, str(landing), store, name).awaitTermination()
    assert closes(spark, store) == expected
    page(landing, "sol-btc-0000.json", [(4, 1.5)])
    deliver_landing(spark, str(landing), store, name).awaitTermination()
    assert closes(spark, store) == expected | {("sol", 4): 1.5}
    # The batch path over the same folder gives the same store.
    history.ingest_landing(spark, str(landing), store)
    assert closes(spark, store) == expected | {("sol", 4): 1.5}


def test_pair_files_import_and_migration(spark, tmp_path):
    import pandas as pd

    folder, store = tmp_path / "files", str(tmp_path / "store")
    folder.mkdir()

    def frame(close):
        return pd.DataFrame({"close": close, "volume_to": 1.0}, index=pd.date_range("2024-01-01", periods=len(close), name="date"))

    frame([0.0, 1.0]).to_parquet(folder / "eth-btc.parquet")
    history.import_pair_files(spark, str(folder), store)
    frame([7.0]).to_parquet(folder / "eth.parquet")
    frame([8.0]).to_parquet(folder / "old.parquet")
    history.migrate_legacy_files(spark, str(folder), store)
    assert closes(spark, store) == {("eth", 1): 1.0, ("old", 0): 8.0}


def test_index_from_store_to_chart_tables(spark, tmp_path):
    store, index_path, comp_path = (str(tmp_path / p) for p in ("store", "index", "comp"))
    prices.write_prices(rows(spark, ["btc", "eth", "sol", "ada", "wbtc", "usdt"], 40), store)
    result = market.build_index(spark, store, index_path, comp_path, top_n=3, window=3)
    assert result.stats.first()["coins_processed"] == 3
    assert market.build_index(spark, store, top_n=3, window=3, entities=["eth", "sol", "ada", "btc"]).index.count() == result.index.count()


def test_index_is_written_and_charted(spark, tmp_path):
    store, index_path, comp_path = (str(tmp_path / p) for p in ("store", "index", "comp"))
    prices.write_prices(rows(spark, ["btc", "eth", "sol", "ada", "wbtc", "usdt"], 40), store)
    market.build_index(spark, store, index_path, comp_path, top_n=3, window=3)
    index, comp = results.read_index(spark, index_path), results.read_composition(spark, comp_path)
    assert index.count() == 38 and comp.filter("coin_id in ('btc', 'wbtc', 'usdt')").isEmpty()
    base = prices.scan_prices(spark, store, "BTC").filter("coin_id = 'btc'")
    tables = market.chart_tables(index, comp, base, cycle_windows([day(-100), day(10)], 10, 20))
    counts = {name: df.count() for name, df in tables.items()}
    assert counts["base_normalised"] == counts["base_absolute"] == 31
    assert counts["index_dual"] == 2 * counts["index_absolute"] == 2 * 29
    assert counts["month_rows"] == comp.count() == 3 * counts["dates"] and counts["changes"] == counts["day_totals"]
    assert counts["months"] == 2 and counts["grid"] == 1


def test_errors(spark, tmp_path):
    store = str(tmp_path / "store")
    prices.write_prices(rows(spark, ["wbtc"], 3), store)
    with pytest.raises(market.NoDataError, match="No eligible"):
        market.build_index(spark, store)
    with pytest.raises(market.NoDataError, match="No cached price data"):
        market.build_index(spark, store, quote="USD")
    with pytest.raises(FileExistsError):
        prices.write_prices(rows(spark, ["eth", "sol", "ada"], 3), store)
    prices.merge_into_store(spark, store, rows(spark, ["eth", "sol", "ada"], 3))
    with pytest.raises(market.NoDataError, match="Could not calculate"):
        market.build_index(spark, store, window=60)
