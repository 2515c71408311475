"""Incremental maintenance of the price history: trim, upsert, dedup, fetch plan.

Keys are (coin_id, quote, date). A pair has at most one row per calendar date, so a window over one
pair is bounded by the calendar; groups that are NOT bounded (copies of the same record) are reduced
on the map side before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import clean_double, sanitise_id
from tidemark.params import ANCHORS, DAYS_BEFORE, DEFAULT_QUOTE, QUOTES

PAIR = ("coin_id", "quote")
KEY = ("coin_id", "quote", "date")


def prefer_pair_rows(rows: DataFrame, legacy_col: str = "is_legacy") -> DataFrame:
    """Drop legacy rows of every pair that also has rows in the pair layout.

    Precedence is decided per pair, not per date. Only legacy rows and the distinct pairs are shuffled;
    the bulk of the store passes straight through.
    """
    modern = rows.filter(~F.col(legacy_col))
    pairs = modern.select(*PAIR).distinct()
    legacy = rows.filter(F.col(legacy_col)).join(pairs, list(PAIR), "left_anti")
    return modern.unionByName(legacy).drop(legacy_col)


def legacy_to_move(store: DataFrame, legacy: DataFrame, quote: str = DEFAULT_QUOTE) -> DataFrame:
    """Legacy series of entities that have no series in ``quote`` yet, as rows of that quote."""
    owned = store.filter(F.upper("quote") == quote).select("coin_id").distinct()
    moved = legacy.withColumn("quote", F.lit(quote)).join(owned, "coin_id", "left_anti")
    return moved.select(*store.columns)


def migrate_legacy(store: DataFrame, legacy: DataFrame, quote: str = DEFAULT_QUOTE) -> DataFrame:
    """Store plus the legacy series it lacks."""
    return store.unionByName(legacy_to_move(store, legacy, quote))


def trim_leading(prices: DataFrame, keys: Sequence[str] = PAIR, close_col: str = "close") -> DataFrame:
    """Drop rows before the first positive close of a series; a series without one stays whole."""
    positive = clean_double(F.col(close_col)) > 0  # NaN would count as larger than 0
    first = F.min(F.when(positive, F.col("date"))).over(Window.partitionBy(*keys))
    return (
        prices.withColumn("_first", first)
        .filter(F.col("_first").isNull() | (F.col("date") >= F.col("_first")))
        .drop("_first")
    )


def keep_one(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``.

    ``row_number() = 1`` becomes a group limit that already runs before the shuffle, so a key that
    holds a large share of all rows sends one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_pick", F.row_number().over(window)).filter(F.col("_pick") == 1).drop("_pick")


def upsert_keep_last(
    base: DataFrame,
    delta: DataFrame,
    keys: Sequence[str] = KEY,
    delta_order: Sequence[Column] | None = None,
) -> DataFrame:
    """``base`` overlaid with ``delta``: the newer row wins per key, everything else is kept.

    Base rows whose key returns in the delta are removed with an anti-join. A delta that Spark finds
    small is broadcast by Spark itself and the base is then not shuffled at all. ``delta_order`` (best
    first) removes repeated keys within the delta. An empty delta leaves the base unchanged.
    """
    fresh = keep_one(delta, keys, delta_order) if delta_order else delta
    kept = base.join(fresh.select(*keys), list(keys), "left_anti")
    return kept.unionByName(fresh.select(*base.columns))


def refresh(
    base: DataFrame, delta: DataFrame, keys: Sequence[str] = PAIR, close_col: str = "close"
) -> DataFrame:
    """``upsert_keep_last`` and ``trim_leading`` in one shuffle and one sort by series.

    For bulk merges, where the trim moves all rows anyway: within a series sorted by date and age, a row
    survives when the next one has another date. Base and delta each hold one row per key.
    """
    both = base.withColumn("_new", F.lit(0)).unionByName(
        delta.select(*base.columns).withColumn("_new", F.lit(1))
    )
    series = Window.partitionBy(*keys).orderBy("date", "_new")
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    newest = ~F.lead("date").over(series).eqNullSafe(F.col("date"))
    positive = F.when(F.col("_newest") & (clean_double(F.col(close_col)) > 0), F.col("date"))
    return (
        both.withColumn("_newest", newest)
        .withColumn("_first", F.min(positive).over(whole))
        .filter(F.col("_newest") & (F.col("_first").isNull() | (F.col("date") >= F.col("_first"))))
        .select(*base.columns)
    )


def dedup_pages(records: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """One record per key: of the newest fetch, and within it the first in the order of its pages.

    ``fetch`` and ``fetched`` (columns of the landing reader) tell fetches apart; without them all pages
    are of one fetch.
    """
    newest = [F.col(c).desc_nulls_last() for c in ("fetch", "fetched") if c in records.columns]
    return keep_one(records, keys, [*newest, F.col("page"), F.col("pos")])


def last_dates(prices: DataFrame) -> DataFrame:
    return prices.groupBy(*PAIR).agg(F.max("date").alias("last_date"))


def fetch_plan(
    entities: DataFrame,
    last: DataFrame,
    as_of: date,
    quotes: Sequence[str] = QUOTES,
    cap: date | None = None,
    history_start: date | None = None,
    incremental: bool = True,
    use_cache: bool = True,
    id_col: str = "id",
) -> DataFrame:
    """What an external downloader has to fetch: one row per entity and quote.

    ``mode`` is "full" (nothing stored, or refresh forced), "incremental", or "current" (nothing to do,
    ``start_date`` NULL). The quotes are a short parameter list and are exploded, not joined. Series are
    looked up by the safe form of the id, as they are stored; the list keeps the entity's own id.
    """
    end = as_of - timedelta(days=1)
    end = min(end, cap) if cap else end
    start = history_start or ANCHORS[0] - timedelta(days=DAYS_BEFORE)
    pairs = entities.select(
        F.col(id_col).alias("coin_id"),
        F.upper(F.coalesce(F.col("symbol"), F.col(id_col))).alias("symbol"),
        F.explode(F.array(*[F.lit(q.upper()) for q in quotes])).alias("quote"),
    )
    seen = F.col("last_date")
    full = F.lit(not (incremental and use_cache)) | seen.isNull()
    mode = F.when(full, "full").when(seen >= F.lit(end), "current").otherwise("incremental")
    return (
        pairs.withColumn("_stored", sanitise_id(F.col("coin_id")))
        .join(last.withColumnRenamed("coin_id", "_stored"), ["_stored", "quote"], "left")
        .withColumn("mode", mode)
        .select(
            "coin_id",
            "symbol",
            "quote",
            F.when(F.col("mode") == "full", F.lit(start))
            .when(F.col("mode") == "incremental", F.date_add(seen, 1))
            .alias("start_date"),
            F.lit(end).alias("end_date"),
            "mode",
        )
    )


def single_quote(prices: DataFrame, quote: str) -> DataFrame:
    return prices.filter(F.col("quote") == quote.upper())
