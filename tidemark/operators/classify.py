"""Entity classification and filtering.

Rules are data (``RuleSet``); every predicate is one native expression, so classification runs inside
the scan stage, needs no shuffle and no join, and can be applied before prices are read further.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import sanitise_id
from tidemark.params import (
    DEFAULT_RULES,
    ENTITY_PAGE,
    MIN_HISTORY_DATE,
    REASON_NO_PRICES,
    REASON_SHORT_HISTORY,
    RuleSet,
)
from tidemark.schema import SKIPPED


def _lower(value: Column) -> Column:
    return F.lower(F.coalesce(value, F.lit("")))


def _in(value: Column, members: Sequence[str]) -> Column:
    return value.isin(list(members)) if members else F.lit(False)


def _matches_any(text: Column, patterns: Sequence[str]) -> Column:
    """One case-insensitive regular expression for all patterns: a single pass over the text."""
    if not patterns:
        return F.lit(False)
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def is_allowed(coin_id: Column, symbol: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    return _in(_lower(coin_id), rules.allowed) | _in(_lower(symbol), rules.allowed)


def _stable(coin_id: Column, symbol: Column, rules: RuleSet) -> Column:
    return _in(_lower(coin_id), rules.stable_ids) | _in(_lower(symbol), rules.stable_symbols)


def _wrapped(coin_id: Column, name: Column, rules: RuleSet) -> Column:
    # The space stays even when the name is empty; patterns that end in $ see the end of the NAME.
    text = F.concat(_lower(coin_id), F.lit(" "), _lower(name))
    return _in(_lower(coin_id), rules.wrapped_ids) | _matches_any(text, rules.wrapped_patterns)


def _base(coin_id: Column, symbol: Column, rules: RuleSet) -> Column:
    return _in(_lower(coin_id), rules.base_ids) | _in(_lower(symbol), rules.base_ids)


def _derivative(coin_id: Column, name: Column, symbol: Column, rules: RuleSet) -> Column:
    text = F.concat(_lower(coin_id), F.lit(" "), _lower(name), F.lit(" "), _lower(symbol))
    by_text = _matches_any(text, [rules.base_pattern]) & _matches_any(text, [rules.derivative_pattern])
    by_list = _in(_lower(coin_id), rules.derivative_symbols) | _in(_lower(symbol), rules.derivative_symbols)
    return ~_base(coin_id, symbol, rules) & (by_text | by_list)


def is_stable(coin_id: Column, name: Column, symbol: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    return ~is_allowed(coin_id, symbol, rules) & _stable(coin_id, symbol, rules)


def is_wrapped(coin_id: Column, name: Column, symbol: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    return ~is_allowed(coin_id, symbol, rules) & _wrapped(coin_id, name, rules)


def is_base_derivative(
    coin_id: Column, name: Column, symbol: Column, rules: RuleSet = DEFAULT_RULES
) -> Column:
    return ~is_allowed(coin_id, symbol, rules) & _derivative(coin_id, name, symbol, rules)


def _first_reason(coin_id: Column, name: Column, symbol: Column, rules: RuleSet, base_too: bool) -> Column:
    """The first rule that applies, in the order in which they are decided."""
    chain = F.when(is_allowed(coin_id, symbol, rules), F.lit(None).cast("string"))
    if base_too:
        chain = chain.when(_base(coin_id, symbol, rules), F.lit(rules.base_reason))
    return (
        chain.when(_stable(coin_id, symbol, rules), F.lit(rules.stable_reason))
        .when(_wrapped(coin_id, name, rules), F.lit(rules.wrapped_reason))
        .when(_derivative(coin_id, name, symbol, rules), F.lit(rules.derivative_reason))
    )


def skip_reason(coin_id: Column, name: Column, symbol: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """Why an entity is not downloaded; NULL keeps it. The base asset itself is kept."""
    return _first_reason(coin_id, name, symbol, rules, base_too=False)


def exclusion_reason(
    coin_id: Column, name: Column, symbol: Column, rules: RuleSet = DEFAULT_RULES
) -> Column:
    """Why an entity is not in the index; NULL keeps it. The allow-list is tested before the base asset."""
    return _first_reason(coin_id, name, symbol, rules, base_too=True)


def classify(
    entities: DataFrame,
    rules: RuleSet = DEFAULT_RULES,
    purpose: str = "download",
    id_col: str = "id",
    name_col: str = "name",
    symbol_col: str = "symbol",
    reason_col: str = "reason",
) -> DataFrame:
    """Add ``reason`` (NULL = keep) for ``purpose`` "download" or "index"."""
    decide = {"download": skip_reason, "index": exclusion_reason}[purpose]
    return entities.withColumn(
        reason_col, decide(F.col(id_col), F.col(name_col), F.col(symbol_col), rules)
    )


def page_url(symbol: Column, base: str = ENTITY_PAGE) -> Column:
    return F.concat(F.lit(base + "/"), F.upper(F.coalesce(symbol, F.lit(""))), F.lit("/overview"))


def accepted(classified: DataFrame, reason_col: str = "reason") -> DataFrame:
    return classified.filter(F.col(reason_col).isNull()).drop(reason_col)


def skipped(
    classified: DataFrame,
    id_col: str = "id",
    name_col: str = "name",
    symbol_col: str = "symbol",
    reason_col: str = "reason",
    page_base: str = ENTITY_PAGE,
) -> DataFrame:
    return classified.filter(F.col(reason_col).isNotNull()).select(
        F.col(id_col).alias("coin_id"),
        F.col(name_col).alias("name"),
        F.col(symbol_col).alias("symbol"),
        F.col(reason_col).alias("reason"),
        page_url(F.col(symbol_col), page_base).alias("url"),
    )


def index_entities(entities: DataFrame, rules: RuleSet = DEFAULT_RULES, **columns: str) -> DataFrame:
    """Records that may enter the index."""
    return accepted(classify(entities, rules, "index", **columns))


def index_rows(rows: DataFrame, rules: RuleSet = DEFAULT_RULES, id_col: str = "coin_id") -> DataFrame:
    """Rows whose bare id may enter the index: the name is empty and the symbol is the id.

    A plain row filter, for tables with one or few rows per entity.
    """
    coin = F.col(id_col)
    return rows.filter(exclusion_reason(coin, F.lit(""), F.upper(coin), rules).isNull())


def index_ids(prices: DataFrame, rules: RuleSet = DEFAULT_RULES, id_col: str = "coin_id") -> DataFrame:
    """Distinct ids of a series table that may enter the index.

    The test mentions the row count, which is always positive: otherwise the optimizer would move it below
    the grouping, and through a semi-join to the prices, and run the patterns on every row after all.
    """
    coin = F.col(id_col)
    reason = exclusion_reason(coin, F.lit(""), F.upper(coin), rules)
    return (
        prices.groupBy(id_col)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.when(F.col("_rows") > 0, reason).isNull())
        .select(id_col)
    )


def index_prices(prices: DataFrame, rules: RuleSet = DEFAULT_RULES, id_col: str = "coin_id") -> DataFrame:
    """Series that may enter the index: like ``index_rows``, but the rules run once per entity.

    The patterns cost more than everything else that happens to a price row. The ids come from a scan of
    one column with map-side distinct; the semi-join has the key of the windows that follow, so the prices
    are shuffled once for both. A hash join needs no sort of them, and its table holds only the ids of one
    partition.
    """
    ids = index_ids(prices, rules, id_col).hint("shuffle_hash")
    return prices.join(ids, id_col, "left_semi")


def reason_counts(skipped_rows: DataFrame) -> DataFrame:
    return skipped_rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def run_counters(classified: DataFrame, reason_col: str = "reason") -> DataFrame:
    """One row: entities fetched, filtered out and accepted."""
    reason = F.col(reason_col)
    return classified.agg(
        F.count(F.lit(1)).alias("fetched"),
        F.count(reason).alias("filtered"),
        F.count_if(reason.isNull()).alias("accepted"),
    )


def _first_dates(prices: DataFrame) -> DataFrame:
    return prices.groupBy("coin_id").agg(F.min("date").alias("start_date"))


def with_history_before(
    entities: DataFrame, prices: DataFrame, cutoff: date = MIN_HISTORY_DATE, id_col: str = "id"
) -> DataFrame:
    """Entities with at least one price before ``cutoff``; entities without prices are dropped.

    ``min(date) < cutoff`` holds exactly when some row is before ``cutoff``, so the date test reaches
    the scan and only the ids of early rows are read. Series are looked up by the safe form of the id.
    """
    early = prices.filter(F.col("date") < F.lit(cutoff)).select(F.col("coin_id").alias("_stored")).distinct()
    return entities.join(early, sanitise_id(F.col(id_col)) == F.col("_stored"), "left_semi")


def without_history_before(
    entities: DataFrame, prices: DataFrame, cutoff: date = MIN_HISTORY_DATE, id_col: str = "id"
) -> DataFrame:
    """The complement: recent entities, including those without any price."""
    early = prices.filter(F.col("date") < F.lit(cutoff)).select(F.col("coin_id").alias("_stored")).distinct()
    return entities.join(early, sanitise_id(F.col(id_col)) == F.col("_stored"), "left_anti")


def append_short_history(
    skipped_rows: DataFrame,
    recent: DataFrame,
    prices: DataFrame,
    id_col: str = "id",
    page_base: str = ENTITY_PAGE,
) -> DataFrame:
    """Skipped list plus the recent entities that are not on it yet (compared by lower-case id)."""
    known = skipped_rows.select(F.lower("coin_id").alias("_known")).distinct()
    symbol = F.coalesce(F.col("symbol"), F.upper(F.col(id_col)))
    short = REASON_SHORT_HISTORY.split("{}")
    fresh = (
        recent.join(known, F.lower(F.col(id_col)) == F.col("_known"), "left_anti")
        .join(
            _first_dates(prices).withColumnRenamed("coin_id", "_stored"),
            sanitise_id(F.col(id_col)) == F.col("_stored"),
            "left",
        )
        .select(
            F.col(id_col).alias("coin_id"),
            F.coalesce(F.col("name"), symbol).alias("name"),
            symbol.alias("symbol"),
            F.when(F.col("start_date").isNull(), F.lit(REASON_NO_PRICES))
            .otherwise(
                F.concat(F.lit(short[0]), F.date_format("start_date", "yyyy-MM-dd"), F.lit(short[1]))
            )
            .alias("reason"),
            page_url(symbol, page_base).alias("url"),
        )
    )
    return skipped_rows.select(*SKIPPED.fieldNames()).unionByName(fresh)


def head(entities: DataFrame, n: int, order_col: str = "market_cap_rank") -> DataFrame:
    """First ``n`` entities of an ordered list."""
    return entities.orderBy(order_col).limit(n)
