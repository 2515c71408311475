"""Rule tables against the literal form of the same rules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import classify as cl
from tidemark.operators import rule_tables as rt
from tidemark.params import DEFAULT_RULES, RuleSet

SCHEMA = "id string, name string, symbol string, gram string, kind string"


def entities(rng, n=300):
    words = ["wrapped", "staked", "btc", "bitcoin", "usd", "bridged", "lido", "sol", "liquid staking", "ether.fi", "vault", "w", "aave", "weth", "rs", "coin"]
    rows = []
    for _ in range(n):
        pick = lambda k: "-".join(rng.choice(words) for _ in range(rng.randint(0, k)))
        rows.append((pick(3) or None, pick(2).title() if rng.random() < 0.9 else None, rng.choice([pick(1).upper(), "USDT", "WBTC", "steth", None]), "g", "k"))
    ids = [*DEFAULT_RULES.stable_ids[:9], *DEFAULT_RULES.wrapped_ids[:9], *DEFAULT_RULES.allowed[:5], *DEFAULT_RULES.base_ids]
    return rows + [(i, None, None, None, None) for i in ids] + rows[:5] + [(None, None, None, None, None)]


@pytest.mark.parametrize("purpose", ["download", "index"])
def test_equal_to_literals(spark, purpose):
    rows = spark.createDataFrame(entities(random.Random(1)), SCHEMA)
    want = cl.classify(rows, DEFAULT_RULES, purpose)
    got = rt.classify_by_tables(rows, rt.rule_table(spark), purpose)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert want.filter("reason IS NOT NULL").count() > 50


@pytest.mark.parametrize(
    "pattern, needed",
    [("liquid.?staking", "staking"), ("bridge[d]?$", "bridge"), ("^w[a-z]{2,6}$", "w"), ("ether\\.?fi", "ether"), ("abc?d", "ab"), ("ab{0,2}c", "a"),
     ("a+b", "a"), ("(x)", None), ("x|y", None), ("\\d+xy", "xy"), (".*", None), ("", None)],
)
def test_needed_text(pattern, needed):
    assert rt.needed_text(pattern) == needed


def test_every_form_of_rule(spark):
    patterns = ("^pre", "post$", "^all$", "mid", "a|b-c", "x.?y", "(q|z)q", ".[0-9]$")
    rules = RuleSet((), (), (), (), patterns, (), "no such", "no such", ())
    rows = [(i, n, s, None, None) for i in ("pre-x", "xpre", "all", "b-c", "xzy", "xy", "qq", "k9", "-", "amid") for n in ("", "post", "post-", None) for s in ("mid", None)]
    table = spark.createDataFrame(rows, SCHEMA)
    want, got = cl.classify(table, rules), rt.classify_by_tables(table, rt.rule_table(spark, rules))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_a_hundred_thousand_rules(spark, plan_of):
    """Rules on ids that mostly do not occur, and one string that all entities hold; no rule meets entities by a product."""
    n = 100_000
    rules = spark.range(n).select(
        F.lit("wrapped").alias("kind"),
        F.lit("id_name").alias("field"),
        F.element_at(F.array(*map(F.lit, ("prefix", "suffix", "contains"))), (F.col("id") % 3 + 1).cast("int")).alias("form"),
        F.concat(F.lit("token-"), (F.col("id") * 7).cast("string"), F.lit("-x")).alias("value"),
    )
    rows = spark.range(2000).select(
        F.concat(F.lit("token-"), F.col("id").cast("string"), F.lit("-x")).alias("id"), F.lit("").alias("name"), F.col("id").cast("string").alias("symbol")
    )
    got = rt.classify_by_tables(rows, rules)
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    flagged = {r["id"] for r in got.filter("reason IS NOT NULL").collect()}
    # The text ends in a space, so suffix rules (every third) match nothing.
    assert flagged == {f"token-{7 * i}-x" for i in range(n) if 7 * i < 2000 and i % 3 != 1}


def test_no_rules_no_entities_and_wrong_arguments(spark, monkeypatch):
    rows, none = spark.createDataFrame(entities(random.Random(2), 5), SCHEMA), spark.createDataFrame([], rt.RULES)
    assert rt.classify_by_tables(rows, none).filter("reason IS NOT NULL").isEmpty()
    assert rt.classify_by_tables(rows.limit(0), rt.rule_table(spark)).count() == 0
    with pytest.raises(ValueError):
        rt.classify_by_tables(rows, none, "other")
    monkeypatch.setattr(rt, "MOST_KEYLESS", 1)
    with pytest.raises(ValueError):
        rt.classify_by_tables(rows, spark.createDataFrame([("wrapped", "id", "regex", p) for p in (".*", ".+")], rt.RULES))
