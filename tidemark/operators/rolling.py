"""Daily series building blocks: roll-up, calendar alignment, trailing mean, warm-up mask, daily rank.

Everything stays in long form with one row per entity and day. Gaps are recognised from the day number,
so no dense calendar is materialised for the index.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import clean_double, day_number


@dataclass(frozen=True)
class Columns:
    """Names of the four columns an index is computed from."""

    entity: str = "coin_id"
    date: str = "date"
    price: str = "close"
    volume: str = "volume_to"


DEFAULT_COLUMNS = Columns()


def align_calendar(
    prices: DataFrame, values: Sequence[str] = ("close", "volume_to"), columns: Columns = DEFAULT_COLUMNS
) -> DataFrame:
    """Every entity on every date between the global first and last date; missing values are NULL.

    Each row fills the gap up to the entity's next row, the first row also fills back to the global
    start: one shuffle by entity, no calendar join. The two bounds are scalar subqueries.
    """
    day = F.col(columns.date)
    low = prices.select(F.min(columns.date)).scalar()
    high = prices.select(F.max(columns.date)).scalar()
    series = Window.partitionBy(columns.entity).orderBy(columns.date)
    spans = prices.select(
        columns.entity,
        *values,
        day.alias("_own"),
        F.when(F.lag(columns.date).over(series).isNull(), F.lit(True)).otherwise(F.lit(False)).alias("_head"),
        F.lead(columns.date).over(series).alias("_next"),
    )
    begin = F.when(F.col("_head"), F.col("_low")).otherwise(F.col("_own"))
    end = F.coalesce(F.date_sub("_next", 1), F.col("_high"))
    filled = (
        spans.withColumn("_low", low)
        .withColumn("_high", high)
        .select(
            columns.entity, *values, "_own", F.explode(F.sequence(begin, end)).alias(columns.date)
        )
    )
    own = F.col("_own") == F.col(columns.date)
    return filled.select(
        columns.entity, columns.date, *[F.when(own, F.col(v)).alias(v) for v in values]
    )


def date_range(prices: DataFrame, columns: Columns = DEFAULT_COLUMNS) -> DataFrame:
    """One row with the first and last date over all entities."""
    return prices.agg(F.min(columns.date).alias("min_date"), F.max(columns.date).alias("max_date"))


_STEP = 4


def _full_window_mean(rows: DataFrame, window: int, value: str, entity: str, out: str) -> DataFrame:
    """Mean of ``value`` over the last ``window`` calendar days, NULL unless every day has a value.

    ``rows`` has one row per entity and day, numbered by ``_day``. Sums over 1, 4, 16, ... rows are built
    from each other with LAG and then added up to ``window``, which costs O(log window) per row; a sliding
    frame adds up the whole window again for every row. A NULL anywhere in the window makes the sum NULL,
    and the row ``window - 1`` places back must be exactly that many days older, so gaps are seen too.
    Sums are only ever added, never subtracted, so nothing cancels.
    """
    series = Window.partitionBy(entity).orderBy("_day")

    def back(column: str, places: int) -> Column:
        return F.lag(column, places).over(series) if places else F.col(column)

    sums = [("_sum1", 1)]
    rows = rows.withColumn("_sum1", F.col(value))
    while sums[-1][1] * _STEP <= window:
        name, size = sums[-1]
        total = reduce(add, [back(name, size * k) for k in range(_STEP)])
        sums.append((f"_sum{size * _STEP}", size * _STEP))
        rows = rows.withColumn(sums[-1][0], total)
    parts, covered = [], 0
    for name, size in reversed(sums):
        while window - covered >= size:
            parts.append(back(name, covered))
            covered += size
    complete = back("_day", window - 1) == F.col("_day") - (window - 1)
    kept = [F.col(c) for c in rows.columns if not c.startswith("_sum")]
    return rows.select(*kept, F.when(complete, reduce(add, parts) / F.lit(float(window))).alias(out))


def rolling_volume(
    prices: DataFrame, window: int, columns: Columns = DEFAULT_COLUMNS, out: str = "volume_sma"
) -> DataFrame:
    """Mean volume of the last ``window`` CALENDAR days, NULL unless every one of them has a volume."""
    rows = prices.withColumn("_day", day_number(F.col(columns.date))).withColumn(
        "_volume", clean_double(F.col(columns.volume))
    )
    return _full_window_mean(rows, window, "_volume", columns.entity, out).drop("_day", "_volume")


def first_volume_days(prices: DataFrame, columns: Columns = DEFAULT_COLUMNS) -> DataFrame:
    """Day number of the first volume per entity: a two-column scan and one row per entity."""
    return (
        prices.filter(clean_double(F.col(columns.volume)).isNotNull())
        .groupBy(columns.entity)
        .agg(F.min(day_number(F.col(columns.date))).alias("_first"))
    )


def smooth_and_mask(
    prices: DataFrame,
    window: int,
    columns: Columns = DEFAULT_COLUMNS,
    sma: str = "volume_sma",
    masked: str = "price",
    first_volume: DataFrame | None = None,
) -> DataFrame:
    """Trailing mean volume, and the price masked during warm-up.

    The price of an entity is NULL up to and including day ``first volume + window - 1``; an entity
    without any volume is not masked. Both results come from windows over one shuffle and sort. When
    ``prices`` is only a recent slice, ``first_volume`` brings the first days of the whole history; the
    join has the windows' own key and shares their shuffle.
    """
    volume = F.col(columns.volume)
    series = prices.select(
        columns.entity,
        columns.date,
        clean_double(F.col(columns.price)).alias(columns.price),
        clean_double(volume).alias(columns.volume),
        day_number(F.col(columns.date)).alias("_day"),
    )
    if first_volume is None:
        whole = (
            Window.partitionBy(columns.entity)
            .orderBy("_day")
            .rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        )
        first = F.min(F.when(volume.isNotNull(), F.col("_day"))).over(whole)
    else:
        series = series.join(first_volume, columns.entity, "left")
        first = F.col("_first")
    smoothed = _full_window_mean(series, window, columns.volume, columns.entity, sma)
    past_warm_up = F.col("_first").isNull() | (F.col("_day") > F.col("_first") + (window - 1))
    return smoothed.withColumn("_first", first).select(
        columns.entity,
        columns.date,
        F.when(past_warm_up, F.col(columns.price)).alias(masked),
        sma,
    )


def top_per_date(
    rows: DataFrame,
    n: int,
    by: str,
    columns: Columns = DEFAULT_COLUMNS,
    rank: str = "rank",
    presplit: int = 64,
) -> DataFrame:
    """The ``n`` rows with the largest ``by`` per date; ties go to the smaller entity id.

    ``row_number() <= n`` becomes a group limit that runs before the shuffle, so a date sends at most
    ``n`` rows per task however many entities it has. Spark does that for ``n`` below a threshold. For all other ``n``,
    or where the threshold is switched off, the rows of a date are ranked in ``presplit`` slices first, so that no
    task ever sorts all entities of a date. The rows are the same either way.
    """
    order = [F.col(by).desc(), F.col(columns.entity)]
    kept = rows.filter(F.col(by).isNotNull())
    limited_by_spark = n < int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if not limited_by_spark:
        piece = F.pmod(F.xxhash64(columns.entity), F.lit(presplit))
        local = Window.partitionBy(columns.date, piece).orderBy(*order)
        kept = kept.withColumn(rank, F.row_number().over(local)).filter(F.col(rank) <= n).drop(rank)
    window = Window.partitionBy(columns.date).orderBy(*order)
    return kept.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
