"""The volume-weighted top-N index and its composition.

Two shuffles in total: by entity for the trailing mean, by date for the rank. The group limit in front
of the second one lets at most top_n rows per date and task through. Index, composition and totals all
derive from the ranked members, which are already partitioned by date.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import clean_double
from tidemark.operators.rolling import (
    DEFAULT_COLUMNS,
    Columns,
    first_volume_days,
    smooth_and_mask,
    top_per_date,
)
from tidemark.params import INDEX_TOP_N, MIN_MEMBERS, VOLUME_WINDOW
from tidemark.session import materialise

PRICE_MASKS = ("reference", "strict")


def ranked_members(
    prices: DataFrame,
    top_n: int = INDEX_TOP_N,
    window: int = VOLUME_WINDOW,
    start: date | None = None,
    end: date | None = None,
    columns: Columns = DEFAULT_COLUMNS,
    price_mask: str = "reference",
    first_volume: DataFrame | None = None,
) -> DataFrame:
    """Members of the index per date: ``date, rank, coin_id, volume, price``; at most ``top_n`` per date.

    ``volume`` is the trailing mean. ``price_mask`` "reference" lets an entity rank on the last day of
    its warm-up, where its volume counts but its price is NULL; "strict" ranks only priced entities.
    ``start`` and ``end`` bound the dates returned; smoothing still sees the days before ``start``. With
    a ``start`` only that many days are read in full, so a daily run does not sort the whole history; the
    days of the first volumes come from the narrow columns of all of it, or from ``first_volume`` (entity and
    ``_first``, a day number) where the caller knows them.
    """
    if price_mask not in PRICE_MASKS:
        raise ValueError(f"price_mask must be one of {PRICE_MASKS}")
    day, volume = F.col(columns.date), F.col(columns.volume)
    # Rows without a volume neither rank nor complete a window.
    source = prices.filter(volume.isNotNull() & ~F.isnan(volume.cast("double")))
    source = source.filter(day <= F.lit(end)) if end else source
    if start:
        recent = source.filter(day >= F.lit(start - timedelta(days=window - 1)))
        smoothed = smooth_and_mask(
            recent,
            window,
            columns,
            "volume",
            "price",
            first_volume_days(source, columns) if first_volume is None else first_volume,
        ).filter(day >= F.lit(start))
    else:
        smoothed = smooth_and_mask(source, window, columns, "volume", "price")
    if price_mask == "strict":
        smoothed = smoothed.filter(F.col("price").isNotNull())
    return top_per_date(smoothed, top_n, "volume", columns).select(
        day.alias("date"), "rank", F.col(columns.entity).alias("coin_id"), "volume", "price"
    )


def index_from_members(members: DataFrame, min_members: int = MIN_MEMBERS) -> DataFrame:
    """Weighted mean price per date: sum(price * volume) / sum(volume).

    A member without a price adds nothing to the numerator but keeps its volume in the denominator.
    Dates without a defined value or with fewer than ``min_members`` members are dropped.
    """
    weighted = F.coalesce(F.sum(F.col("price") * F.col("volume")), F.lit(0.0))
    return (
        members.groupBy("date")
        .agg(
            (weighted / F.nullif(F.sum("volume"), F.lit(0.0))).alias("index_price"),
            F.sum("volume").alias("total_volume"),
            F.count(F.lit(1)).alias("coin_count"),
        )
        .filter(F.col("index_price").isNotNull() & (F.col("coin_count") >= min_members))
    )


def composition_from_members(members: DataFrame, min_members: int = MIN_MEMBERS) -> DataFrame:
    """Priced members of every valid date with their share of the volume of ALL ranked members."""
    per_date = Window.partitionBy("date")
    return (
        members.withColumn("_total", F.sum("volume").over(per_date))
        .withColumn("_count", F.count(F.lit(1)).over(per_date))
        .filter((F.col("_count") >= min_members) & (F.col("_total") > 0) & F.col("price").isNotNull())
        .select(
            "date", "rank", "coin_id", "volume", (F.col("volume") / F.col("_total")).alias("weight"), "price"
        )
    )


def weighted_index(
    prices: DataFrame,
    top_n: int = INDEX_TOP_N,
    window: int = VOLUME_WINDOW,
    start: date | None = None,
    end: date | None = None,
    columns: Columns = DEFAULT_COLUMNS,
    price_mask: str = "reference",
    min_members: int = MIN_MEMBERS,
) -> DataFrame:
    members = ranked_members(prices, top_n, window, start, end, columns, price_mask)
    return index_from_members(members, min_members)


def composition(
    prices: DataFrame,
    top_n: int = INDEX_TOP_N,
    window: int = VOLUME_WINDOW,
    start: date | None = None,
    end: date | None = None,
    columns: Columns = DEFAULT_COLUMNS,
    price_mask: str = "reference",
    min_members: int = MIN_MEMBERS,
) -> DataFrame:
    members = ranked_members(prices, top_n, window, start, end, columns, price_mask)
    return composition_from_members(members, min_members)


def single_day_members(
    prices: DataFrame, day: date, top_n: int = INDEX_TOP_N, columns: Columns = DEFAULT_COLUMNS
) -> DataFrame:
    """Unsmoothed composition of one date: entities with positive price and volume, at least three.

    The minimum is tested on all entities of the day, before the cut: ranking ``max(top_n, 3)`` rows
    shows whether there are three without counting the day separately.
    """
    price, volume = clean_double(F.col(columns.price)), clean_double(F.col(columns.volume))
    rows = prices.filter(F.col(columns.date) == F.lit(day)).select(
        columns.date, columns.entity, price.alias("price"), volume.alias("volume")
    )
    rows = rows.filter((F.col("price") > 0) & (F.col("volume") > 0))
    per_date = Window.partitionBy("date")
    return (
        top_per_date(rows, max(top_n, MIN_MEMBERS), "volume", columns)
        .withColumnsRenamed({columns.date: "date", columns.entity: "coin_id"})
        .withColumn("_count", F.count(F.lit(1)).over(per_date))
        .filter((F.col("_count") >= MIN_MEMBERS) & (F.col("rank") <= top_n))
        .withColumn("weight", F.col("volume") / F.sum("volume").over(per_date))
        .select("date", "rank", "coin_id", "volume", "weight", "price")
    )


def single_day_index(
    prices: DataFrame, day: date, top_n: int = INDEX_TOP_N, columns: Columns = DEFAULT_COLUMNS
) -> DataFrame:
    """Unsmoothed index of one date; no row when fewer than three entities qualify."""
    return index_from_members(single_day_members(prices, day, top_n, columns), min_members=1)


def index_stats(index: DataFrame, entities: DataFrame, columns: Columns = DEFAULT_COLUMNS) -> DataFrame:
    """One row: entities processed, first and last valid date, days, mean member count.

    ``entities`` are the prices, or any shorter table with the same entities.
    """
    entities = entities.select(F.count_distinct(columns.entity)).scalar()
    return index.agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("n_days"),
        F.avg("coin_count").alias("avg_coins"),
    ).withColumn("coins_processed", entities)


def latest(index: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most recent rows."""
    return index.orderBy(F.col("date").desc()).limit(k)


def coverage(prices: DataFrame, columns: Columns = DEFAULT_COLUMNS, quote: str | None = None) -> DataFrame:
    """First date, last date and number of days per entity, of one quote or, where there are several, of each.

    Prices with a ``quote`` column are grouped by it too, unless ``quote`` names the one that counts.
    """
    keys = [F.col(columns.entity).alias("coin_id")]
    if quote:
        prices = prices.filter(F.upper("quote") == quote.upper())
    elif "quote" in prices.columns:
        keys.append(F.upper("quote").alias("quote"))
    return prices.groupBy(*keys).agg(
        F.min(columns.date).alias("start_date"),
        F.max(columns.date).alias("end_date"),
        F.count(F.lit(1)).alias("days"),
    )


def within(column: Column, start: date | None, end: date | None) -> Column:
    """Test for a range of dates, both ends included; a missing end is open."""
    test = F.lit(True)
    if start:
        test = test & (column >= F.lit(start))
    if end:
        test = test & (column <= F.lit(end))
    return test


def in_range(rows: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Rows of a date range, both ends included."""
    return rows.filter(within(F.col("date"), start, end))


def composition_at(members: DataFrame, day: date) -> DataFrame:
    """Composition of one date by rank; at most top_n rows."""
    return members.filter(F.col("date") == F.lit(day)).orderBy("rank")


def entity_history(members: DataFrame, coin_id: str) -> DataFrame:
    """Every date an entity was a member, in order."""
    return members.filter(F.col("coin_id") == coin_id).orderBy("date")


@dataclass(frozen=True)
class IndexResult:
    """Index, composition and run statistics. Reading them runs jobs; what ``share`` wrote is not computed again."""

    index: DataFrame
    composition: DataFrame
    stats: DataFrame


def compute_index(
    prices: DataFrame,
    top_n: int = INDEX_TOP_N,
    window: int = VOLUME_WINDOW,
    start: date | None = None,
    end: date | None = None,
    columns: Columns = DEFAULT_COLUMNS,
    price_mask: str = "reference",
    share: bool = True,
    first_volume: DataFrame | None = None,
    entities: DataFrame | None = None,
) -> IndexResult:
    """Index and composition from one ranking.

    With ``share`` this call itself runs the ranking: the ranked members (at most top_n rows per date) are
    written once to the shared folder, so the expensive stages run once for both outputs and survive executor
    loss. Without it nothing runs before a result is read. ``first_volume`` is as in ``ranked_members``;
    ``entities``, a table of the ids in ``prices``, spares the statistics a scan of them.
    """
    members = ranked_members(prices, top_n, window, start, end, columns, price_mask, first_volume)
    if share:
        members = materialise(members, "members")
    index = index_from_members(members)
    return IndexResult(index, composition_from_members(members), index_stats(index, prices if entities is None else entities, columns))
