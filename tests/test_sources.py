from __future__ import annotations

import json
from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.functions import sanitise_id
from tidemark.schema import COMPOSITION, INDEX, PRICES
from tidemark.sources import lists, payloads, prices, results

D = date(2024, 1, 1)


def day(n: int, month: int = 1) -> date:
    return date(2024, month, n)


def price_rows(spark, rows):
    """Rows from (coin, quote, date, close)."""
    return spark.createDataFrame([(c, q, d, 1.0, 2.0, 0.5, v, 10.0, 20.0) for c, q, d, v in rows], PRICES)


def stored(spark, path, **bounds):
    return sorted((r["coin_id"], r["quote"], r["date"], r["close"]) for r in prices.scan_prices(spark, path, **bounds).collect())


def test_pair_files(spark, tmp_path):
    def frame(close, name="date", start="2024-01-01 05:00"):
        index = pd.date_range(start, periods=len(close), name=name)
        return pd.DataFrame({"close": close, "volume_to": 1.0}, index=index)

    frame([1.0, float("nan")]).to_parquet(tmp_path / "eth-btc.parquet")
    frame([9.0]).to_parquet(tmp_path / "eth.parquet")
    frame([3.0], name=None).to_parquet(tmp_path / "old.parquet")
    frame([4.0]).to_parquet(tmp_path / "a-b-usd.parquet")
    (tmp_path / "bad-btc.parquet").write_bytes(b"not a parquet file")
    rows = prices.load_pair_files(spark, str(tmp_path))
    got = sorted((r["coin_id"], r["quote"], r["date"], r["close"], r["open"]) for r in rows.fillna(-1.0, ["close"]).collect())
    assert got == [
        ("a-b", "USD", D, 4.0, None),
        ("eth", "BTC", D, 1.0, None),
        ("eth", "BTC", day(2), -1.0, None),
        ("old", "BTC", D, 3.0, None),
    ]
    legacy = {r["coin_id"] for r in prices.read_pair_files(spark, str(tmp_path)).filter("is_legacy").collect()}
    assert legacy == {"eth", "old"}


def test_one_pair_opens_one_file(spark, tmp_path):
    index = pd.date_range("2024-01-01", periods=3)
    for name in ("eth-btc", "eth", "eth-usd", "sol-btc", "sol", "a_b-usd", *(f"c{i}-btc" for i in range(40))):
        pd.DataFrame({"close": [1.0, 2.0, 3.0]}, index=index).to_parquet(tmp_path / f"{name}.parquet")

    def opened(df) -> int:
        """Files that the scans of an executed plan read, by their own count."""
        df.collect()
        found, todo = 0, [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            node = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node
            if node.nodeName().startswith("Scan binaryFile"):
                found += node.metrics().apply("numFiles").value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
        return found

    folder = str(tmp_path)
    assert opened(prices.read_pair_files(spark, folder, ["eth"], ["usd"])) == 1
    assert opened(prices.read_pair_files(spark, folder, ["sol"], ["btc"])) == 2  # and its legacy file
    assert opened(prices.read_pair_files(spark, folder, quotes=["USD"])) == 2
    assert opened(prices.read_pair_files(spark, folder, [])) == 0
    got = prices.get_prices(spark, folder, "a.b", "usd").collect()
    assert [(r["coin_id"], r["close"]) for r in got] == [("a_b", 1.0), ("a_b", 2.0), ("a_b", 3.0)]
    assert prices.get_prices(spark, folder, "none").count() == 0


def test_sanitised_ids(spark):
    df = spark.createDataFrame([("coin/with:special",), ("a-b_c9",), ("é.ß 2",)], "i string")
    assert [r[0] for r in df.select(sanitise_id(F.col("i"))).collect()] == ["coin_with_special", "a-b_c9", "é_ß_2"]


def test_store_trims_lists_and_prunes(spark, tmp_path, plan_of):
    path = str(tmp_path / "store")
    rows = price_rows(
        spark,
        [("e/x", "btc", day(1), 0.0), ("e/x", "btc", day(2), 1.0), ("e/x", "btc", day(3, 2), 2.0), ("s", "USD", day(1), 5.0)],
    )
    prices.write_prices(rows, path)
    assert stored(spark, path) == [
        ("e_x", "BTC", day(2), 1.0),
        ("e_x", "BTC", day(3, 2), 2.0),
        ("s", "USD", day(1), 5.0),
    ]
    scan = prices.scan_prices(spark, path, "btc", start=day(5), end=day(10, 3))
    assert scan.count() == 1
    plan = plan_of(scan.select("coin_id", "date"))
    assert "PartitionFilters: [isnotnull(quote" in plan and "month" in plan.split("PartitionFilters")[1]
    assert "volume_to" not in plan
    pairs = [tuple(r) for r in prices.list_pairs(prices.scan_prices(spark, path)).collect()]
    assert pairs == [("e_x", "BTC"), ("s", "USD")]
    assert [r[0] for r in prices.list_coins(prices.scan_prices(spark, path), "usd").collect()] == ["s"]


def test_merge_rewrites_only_touched_months(spark, tmp_path):
    path = str(tmp_path / "store")
    prices.write_prices(price_rows(spark, [("a", "BTC", day(1), 1.0), ("a", "BTC", day(1, 2), 2.0), ("b", "USD", day(1), 3.0)]), path)

    def files():
        return {str(p.relative_to(path)) for p in (tmp_path / "store").rglob("*.parquet")}

    before = files()
    delta = price_rows(spark, [("a", "BTC", day(1, 2), 20.0), ("a", "BTC", day(2, 2), 21.0), ("n", "BTC", day(1, 2), 0.0), ("n", "BTC", day(2, 2), 7.0)])
    expected = [
        ("a", "BTC", day(1), 1.0),
        ("a", "BTC", day(1, 2), 20.0),
        ("a", "BTC", day(2, 2), 21.0),
        ("b", "USD", day(1), 3.0),
        ("n", "BTC", day(2, 2), 7.0),
    ]
    for _ in range(2):
        prices.merge_into_store(spark, path, delta)
        assert stored(spark, path) == expected
    untouched = {f for f in before if "month=2024-01" in f}
    assert len(untouched) == 2 and untouched <= files()


def test_merge_trims_rows_that_became_leading(spark, tmp_path):
    path = str(tmp_path / "store")
    # No positive close yet, so nothing was trimmed; the increment makes all of it leading zeros.
    prices.write_prices(price_rows(spark, [("z", "BTC", day(1), 0.0), ("z", "BTC", day(2), 0.0), ("a", "USD", day(2), 1.0)]), path)
    assert len(stored(spark, path)) == 3
    prices.merge_into_store(spark, path, price_rows(spark, [("z", "BTC", day(1, 2), 4.0)]))
    assert stored(spark, path) == [("a", "USD", day(2), 1.0), ("z", "BTC", day(1, 2), 4.0)]
    assert not (tmp_path / "store" / "quote=BTC" / "month=2024-01").exists()


def test_full_refresh_replaces_the_series(spark, tmp_path):
    path = str(tmp_path / "store")
    prices.write_prices(price_rows(spark, [("a", "BTC", day(1), 1.0), ("a", "BTC", day(5, 2), 2.0), ("b", "BTC", day(1), 3.0)]), path)
    prices.merge_into_store(spark, path, price_rows(spark, [("a", "BTC", day(2), 9.0)]), replace=True)
    assert stored(spark, path) == [("a", "BTC", day(2), 9.0), ("b", "BTC", day(1), 3.0)]


def test_bucketed_copy_needs_no_shuffle_by_entity(spark, plan_of):
    from tidemark.operators.index import weighted_index

    rows = price_rows(spark, [(c, "BTC", day(n), 1.0) for c in "abcd" for n in range(1, 8)])
    prices.write_bucketed(rows, "bucketed_prices", 4)
    table = spark.table("bucketed_prices")
    plan = plan_of(weighted_index(table, 3, 2))
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(date" in plan
    assert weighted_index(table, 3, 2).count() == 6
    spark.sql("DROP TABLE bucketed_prices")


def test_history_payload_files(spark, tmp_path):
    def record(when, close, **extra):
        seconds = int(datetime.combine(when, datetime.min.time()).timestamp()) if when else None
        body = {"open": 1, "high": 2.5, "low": 0.5, "close": close, "volumefrom": 1000, "volumeto": 50, **extra}
        return body | ({"time": 1704067200 + (when - D).days * 86400} if seconds is not None else {})

    def page(name, records, response="Success"):
        body = {"Response": response, "Message": "", "Data": {"Data": records}}
        (tmp_path / name).write_text(json.dumps(body, indent=1))

    page("eth-btc-0000.json", [record(day(3), 3.0, conversionType="x"), record(day(4), 4.0), record(None, 9.0)])
    page("eth-btc-0001.json", [record(day(1), 1.0), record(day(2), 2.0), record(day(3), 33.0)])
    page("a-b-usd-0000.json", [])
    (tmp_path / "bad-usd-0000.json").write_text(json.dumps({"Response": "Error", "Message": "Invalid symbol"}))
    pages = payloads.read_history_pages(spark, str(tmp_path))
    records = payloads.history_records(pages, day(2))
    got = sorted((r["date"], r["page"], r["pos"], r["close"], r["volume_to"]) for r in records.collect())
    assert got == [
        (day(2), 1, 1, 2.0, 50.0),
        (day(3), 0, 0, 3.0, 50.0),
        (day(3), 1, 2, 33.0, 50.0),
        (day(4), 0, 1, 4.0, 50.0),
    ]
    failed = payloads.failed_pages(pages).collect()
    assert [(r["coin_id"], r["quote"], r["Message"]) for r in failed] == [("bad", "USD", "Invalid symbol")]


def test_dates_do_not_depend_on_the_session_zone(spark, tmp_path):
    text = json.dumps({"Response": "Success", "Data": {"Data": [{"time": 1704067200, "close": 1.0}]}})
    raw = spark.createDataFrame([("eth", "BTC", 0, text)], "coin_id string, quote string, page int, payload string")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        row = payloads.history_records(payloads.parse_history_pages(raw)).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row["date"] == D and row["open"] is None


def test_ranking_pages(spark, tmp_path):
    def coin(symbol, raw):
        return {"CoinInfo": {"Name": symbol, "FullName": symbol + " coin"}, "RAW": raw}

    usd = {"MKTCAP": 5.5, "PRICE": 1, "VOLUME24HOUR": 2, "CIRCULATINGSUPPLY": 3, "TYPE": "5"}
    (tmp_path / "ranking-0000.json").write_text(
        json.dumps({"Data": [coin("BTC", {"USD": usd}), coin("NO", {}), coin("EMPTY", {"USD": {}}), {"CoinInfo": {"Name": "BARE"}}]})
    )
    (tmp_path / "ranking-0001.json").write_text(
        json.dumps({"Data": [coin("EUR", {"EUR": usd}), coin("Eth", {"USD": {"PRICE": 7}}), coin("SOL", {"USD": {"TYPE": "5"}})]})
    )
    pages = payloads.read_ranking_pages(spark, str(tmp_path))
    got = [tuple(r) for r in payloads.ranked_entities(pages).orderBy("market_cap_rank").collect()]
    assert got == [
        ("btc", "BTC", "BTC coin", 5.5, 1, 1.0, 2.0, 3.0),
        ("eth", "Eth", "Eth coin", 0.0, 2, 7.0, 0.0, 0.0),
        ("sol", "SOL", "SOL coin", 0.0, 3, 0.0, 0.0, 0.0),
    ]
    assert [r["id"] for r in payloads.ranked_entities(pages, 1).collect()] == ["btc"]


def test_symbol_dictionary(spark, tmp_path):
    path = tmp_path / "symbols.json"
    path.write_text(json.dumps({"Data": {"ETH": {"Id": "1", "Symbol": "ETH"}, "SOL": {"FullName": "Solana"}}}))
    rows = {r["key"]: (r["Id"], r["FullName"]) for r in payloads.read_symbol_dictionary(spark, str(path)).collect()}
    assert rows == {"ETH": ("1", None), "SOL": (None, "Solana")}


def test_accepted_list(spark, tmp_path):
    array = tmp_path / "accepted.json"
    array.write_text(json.dumps([{"id": "btc", "symbol": "BTC", "market_cap": 2}, {"id": "eth"}], indent=2))
    rows = lists.read_entities(spark, str(array), multi_line=True)
    assert sorted((r["position"], r["id"], r["market_cap"]) for r in rows.collect()) == [(1, "btc", 2.0), (2, "eth", None)]
    lists.write_entities(rows, str(tmp_path / "list"))
    again = lists.read_entities(spark, str(tmp_path / "list"))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))
    with pytest.raises(AnalysisException):
        lists.read_entities(spark, str(tmp_path / "absent"))


def test_skipped_list(spark, tmp_path):
    path = str(tmp_path / "skipped")
    rows = [("wbtc", "Wrapped Bitcoin", "WBTC", "why", "u"), ("a", 'S;1 "q"', "", "why", "u")]
    df = spark.createDataFrame(rows, "coin_id string, name string, symbol string, reason string, url string")
    lists.write_skipped(df, path)
    text = [line for p in sorted((tmp_path / "skipped").glob("*.csv")) for line in p.read_text().splitlines()]
    body = [line for line in text if not line.startswith("Coin ID")]
    assert "Coin ID;Name;Symbol;Reason;URL" in text
    assert body == ['a;"S;1 ""q""";;why;u', "wbtc;Wrapped Bitcoin;WBTC;why;u"]
    got = {r["coin_id"]: tuple(r)[1:] for r in lists.read_skipped(spark, path).collect()}
    assert got["wbtc"] == ("Wrapped Bitcoin", "WBTC", "why", "u")
    assert got["a"] == ('"S', '1 ""q"""', "", "why")  # quotes mean nothing to the reader
    short = tmp_path / "short.csv"
    short.write_text("Coin ID;Name;Symbol;Reason;URL\nx;1;2;3\n\t y;1;2;3;4;5 \n\n")
    assert [tuple(r) for r in lists.read_skipped(spark, str(short)).collect()] == [("y", "1", "2", "3", "4")]


def test_skipped_list_spreads_a_hot_id(spark, tmp_path):
    path = str(tmp_path / "hot")
    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), "id")).alias("coin_id"),
        *[F.lit("x").alias(c) for c in ("name", "symbol", "reason")],
        F.col("id").cast("string").alias("url"),
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lists.write_skipped(rows, path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    parts = [p.read_text().splitlines()[1:] for p in sorted((tmp_path / "hot").glob("*.csv"))]
    assert max(map(len, parts)) < 2000 and sum(map(len, parts)) == 4000
    ids = [line.split(";")[0] for part in parts for line in part]
    assert ids == sorted(ids)
    hot = [int(line.rsplit(";", 1)[1]) for part in parts for line in part if line.startswith("hot;")]
    assert hot == sorted(hot)


def test_results_round_trip(spark, tmp_path):
    index = spark.createDataFrame([(day(n), 0.04, 12500.0, 50) for n in (1, 2, 3)], INDEX)
    comp = spark.createDataFrame([(day(1), 1, "eth", 1.0, 0.8, 0.05), (day(1, 2), 1, "eth", 1.0, 0.8, 0.05)], COMPOSITION)
    results.write_index(index, str(tmp_path / "i"))
    results.write_index(index.limit(2), str(tmp_path / "i"))
    assert results.read_index(spark, str(tmp_path / "i")).count() == 2
    assert not results.write_composition(comp.limit(0), str(tmp_path / "c"))
    with pytest.raises(AnalysisException):
        results.read_composition(spark, str(tmp_path / "c")).count()
    assert results.write_composition(comp, str(tmp_path / "c"))
    assert sorted(map(tuple, results.read_composition(spark, str(tmp_path / "c")).collect())) == sorted(map(tuple, comp.collect()))
    assert results.read_composition(spark, str(tmp_path / "c"), "2024-02").count() == 1
    with pytest.raises(AnalysisException):
        results.read_index(spark, str(tmp_path / "none"))
