from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import classify as cl
from tidemark.params import DEFAULT_RULES

# Ids and names of traded assets with the class that each must get; they have to be as they are traded.
WRAPPED = [
    ("steth", "Lido Staked Ether"),
    ("wsteth", "Wrapped stETH"),
    ("wbtc", "Wrapped Bitcoin"),
    ("weth", "Wrapped Ether"),
    ("wbeth", "Wrapped Beacon ETH"),
    ("weeth", "Wrapped eETH"),
    ("jitosol", "Jito Staked SOL"),
    ("reth", "Rocket Pool ETH"),
    ("wbnb", "Wrapped BNB"),
    ("bnsol", "Binance Staked SOL"),
    ("rseth", "Kelp DAO Restaked ETH"),
    ("fbtc", "Ignition FBTC"),
    ("lbtc", "Lombard Staked BTC"),
    ("solvbtc", "Solv BTC"),
    ("lseth", "Liquid Staked ETH"),
    ("ezeth", "Renzo Restaked ETH"),
    ("meth", "Mantle Staked Ether"),
    ("oseth", "StakeWise Staked ETH"),
    ("tbtc", "tBTC"),
    ("msol", "Marinade Staked SOL"),
    ("ethx", "Stader ETHx"),
    ("eeth", "Ether.fi Staked ETH"),
    ("sweth", "Swell Staked ETH"),
    ("cbeth", "Coinbase Wrapped Staked ETH"),
]
KEPT = [
    ("sui", "Sui"),
    ("sei", "Sei"),
    ("stk", "STK"),
    ("sand", "The Sandbox"),
    ("wif", "dogwifhat"),
    ("xlm", "Stellar"),
    ("stx", "Stacks"),
    ("strk", "Starknet"),
    ("storj", "Storj"),
    ("eth", "Ethereum"),
    ("sol", "Solana"),
    ("ada", "Cardano"),
    ("dot", "Polkadot"),
    ("avax", "Avalanche"),
    ("link", "Chainlink"),
]
STABLE = "usdt usdc dai usds usde pyusd fdusd tusd frax gho usdd".split()
DERIVATIVES = [
    ("wbtc", "Wrapped Bitcoin"),
    ("tbtc", "tBTC"),
    ("solvbtc", "Solv BTC"),
    ("lbtc", "Lombard Staked BTC"),
    ("cbbtc", "Coinbase Wrapped BTC"),
]
ALLOWED = "sui sei stk sand wif xlm stx strk".split()


@pytest.fixture(scope="module")
def flags(spark):
    """All flags of every case, computed in one job."""
    cases = [(i, n, i.upper()) for i, n in WRAPPED + KEPT + DERIVATIVES]
    cases += [(s, "", s.upper()) for s in STABLE] + [("btc", "Bitcoin", "BTC"), ("wxyz", "", "WXYZ")]
    cases += [("x1", "Fooswell", "X1"), ("abc", "Some Bridge", "ABC"), ("yv", "Bitcoin Yield", "YV"), ("z", None, None)]
    cases += [("other", "Dai", "DAI"), ("q", "", "SUSDE"), ("stx2", "staked-thing", "STX")]
    df = spark.createDataFrame(sorted(set(cases), key=str), "id string, name string, symbol string")
    args = [F.col("id"), F.col("name"), F.col("symbol")]
    rows = df.select(
        "id",
        "name",
        cl.is_allowed(F.col("id"), F.col("symbol")).alias("allowed"),
        cl.is_stable(*args).alias("stable"),
        cl.is_wrapped(*args).alias("wrapped"),
        cl.is_base_derivative(*args).alias("derivative"),
        cl.skip_reason(*args).alias("skip"),
        cl.exclusion_reason(*args).alias("exclude"),
    ).collect()
    return {(r["id"], r["name"]): r for r in rows}


def test_wrapped_and_staked_are_detected(flags):
    assert [c for c in WRAPPED if not flags[c]["wrapped"]] == []


def test_other_entities_are_kept(flags):
    assert [c for c in KEPT if flags[c]["wrapped"]] == []


def test_stable_entities_are_detected(flags):
    assert [s for s in STABLE if not flags[(s, "")]["stable"]] == []


def test_derivatives_are_detected_but_not_the_base(flags):
    assert [c for c in DERIVATIVES if not flags[c]["derivative"]] == []
    base = flags[("btc", "Bitcoin")]
    assert not base["derivative"] and base["skip"] is None
    assert base["exclude"] == DEFAULT_RULES.base_reason


def test_allow_list_wins(flags):
    for coin in ALLOWED:
        row = next(r for (i, _), r in flags.items() if i == coin)
        assert row["allowed"] and not row["wrapped"] and not row["stable"] and row["exclude"] is None
    assert flags[("stx2", "staked-thing")]["skip"] is None  # allowed by symbol


def test_anchored_patterns_see_id_and_name_together(flags):
    # "^w[a-z]{2,6}$" can never match, because the searched text always holds a space.
    assert not flags[("wxyz", "")]["wrapped"]
    assert flags[("x1", "Fooswell")]["wrapped"]
    assert flags[("abc", "Some Bridge")]["wrapped"]
    assert flags[("yv", "Bitcoin Yield")]["skip"] == DEFAULT_RULES.derivative_reason
    assert flags[("z", None)]["skip"] is None


def test_symbol_list_is_smaller_than_id_list(flags):
    assert flags[("other", "Dai")]["stable"]
    assert not flags[("q", "")]["stable"]


@pytest.fixture(scope="module")
def workflow(spark):
    rows = [
        ("eth", "Ethereum", "ETH"),
        ("wbtc", "Wrapped Bitcoin", "WBTC"),
        ("steth", "Lido Staked Ether", "STETH"),
        ("usdt", "Tether", "USDT"),
        ("usdc", "USD Coin", "USDC"),
        ("btc", "Bitcoin", "BTC"),
        ("sui", "Sui", "SUI"),
    ]
    return spark.createDataFrame(rows, "id string, name string, symbol string")


def test_split_summary_and_counters(workflow):
    classified = cl.classify(workflow)
    assert {r["id"] for r in cl.accepted(classified).collect()} == {"eth", "btc", "sui"}
    off = cl.skipped(classified)
    assert {r["coin_id"]: r["url"].rsplit("/", 2)[1] for r in off.collect()}["steth"] == "STETH"
    assert {r["reason"]: r["n"] for r in cl.reason_counts(off).collect()} == {
        "Wrapped/Staked/Bridged token": 2,
        "Stablecoin": 2,
    }
    assert cl.run_counters(classified).first().asDict() == {"fetched": 7, "filtered": 4, "accepted": 3}


def test_index_filter_on_records_and_on_bare_ids(workflow, plan_of):
    assert {r["id"] for r in cl.index_entities(workflow).collect()} == {"eth", "sui"}
    bare = workflow.select(F.col("id").alias("coin_id"))
    rows = cl.index_rows(bare)
    assert {r["coin_id"] for r in rows.collect()} == {"eth", "sui"}
    plan = plan_of(rows)
    assert "Exchange" not in plan and "Python" not in plan


def test_rules_run_once_per_entity_and_share_the_shuffle(spark, plan_of):
    from tidemark.operators.index import weighted_index

    coins = ["eth", "wbtc", "usdt", "sol", "ada", "aethx", "sui"]
    rows = [(c, date(2024, 1, n), 1.0, 5.0) for c in coins for n in range(1, 5)]
    prices = spark.createDataFrame(rows, "coin_id string, date date, close double, volume_to double")
    kept = cl.index_prices(prices)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, cl.index_rows(prices).collect()))
    assert {r["coin_id"] for r in cl.index_ids(prices).collect()} == {"eth", "sol", "ada", "sui"}
    plan = plan_of(weighted_index(cl.index_prices(prices), 3, 2))
    # prices by entity, ids by entity, ranks by date
    assert plan.count("Exchange") == 3 and "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    # The patterns run above the grouping and nowhere else.
    assert plan.count("RLIKE") == plan.split("HashAggregate(keys=[coin_id")[-3].count("RLIKE") > 0


def test_history_filters_and_append(spark):
    prices = spark.createDataFrame(
        [("a", date(2024, 1, 9)), ("b", date(2024, 1, 10)), ("b", date(2024, 2, 1))], "coin_id string, date date"
    )
    entities = spark.createDataFrame(
        [("a", "A", "Alpha"), ("b", None, None), ("C", "CC", None)], "id string, symbol string, name string"
    )
    assert [r["id"] for r in cl.with_history_before(entities, prices).collect()] == ["a"]
    recent = cl.without_history_before(entities, prices)
    assert {r["id"] for r in recent.collect()} == {"b", "C"}
    known = spark.createDataFrame(
        [("c", "x", "X", "Stablecoin", "u")], "coin_id string, name string, symbol string, reason string, url string"
    )
    rows = {r["coin_id"]: r for r in cl.append_short_history(known, recent, prices).collect()}
    assert set(rows) == {"b", "c"}  # C is listed already, compared by lower case
    assert rows["b"]["reason"] == "Insufficient historical data (starts 2024-01-10)"
    assert rows["b"]["symbol"] == rows["b"]["name"] == "B"
    alone = cl.append_short_history(known.limit(0), recent, prices).filter("coin_id = 'C'").first()
    assert alone["reason"] == "No price data available" and alone["name"] == "CC"
