"""Event cycles: slices around anchor dates, days from the anchor, values relative to the anchor.

The anchors are a short list of parameters. A row is assigned to its cycles by one expression that is
exploded, so slicing needs neither a join nor a shuffle; overlapping windows put a row in several
cycles on purpose. Per (series, cycle) there are at most before + after + 1 rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import clean_double, cycle_label
from tidemark.params import ANCHORS, DAYS_AFTER, DAYS_BEFORE, SUMMARY_TOP_N


@dataclass(frozen=True)
class Cycle:
    number: int
    start: date
    anchor: date
    end: date


def cycle_windows(
    anchors: Sequence[date] = ANCHORS, before: int = DAYS_BEFORE, after: int = DAYS_AFTER
) -> list[Cycle]:
    return [
        Cycle(n, a - timedelta(days=before), a, a + timedelta(days=after))
        for n, a in enumerate(anchors, start=1)
    ]


DEFAULT_CYCLES = tuple(cycle_windows())


def cycle_dimension(spark: SparkSession, cycles: Sequence[Cycle] = DEFAULT_CYCLES) -> DataFrame:
    """The cycles as a table: ``cycle, start_date, anchor_date, end_date``."""
    return spark.createDataFrame(
        [(c.number, c.start, c.anchor, c.end) for c in cycles],
        "cycle int, start_date date, anchor_date date, end_date date",
    )


def cycle_slice(
    series: DataFrame, cycles: Sequence[Cycle] = DEFAULT_CYCLES, date_col: str = "date"
) -> DataFrame:
    """Rows of each cycle window, with ``cycle`` and signed ``days_from_anchor``."""
    day = F.col(date_col)
    reach = day.between(F.lit(min(c.start for c in cycles)), F.lit(max(c.end for c in cycles)))
    hits = [
        F.when(
            day.between(F.lit(c.start), F.lit(c.end)),
            F.struct(
                F.lit(c.number).alias("cycle"), F.datediff(day, F.lit(c.anchor)).alias("days_from_anchor")
            ),
        )
        for c in cycles
    ]
    return (
        series.filter(reach)
        .withColumn("_hit", F.explode(F.array(*hits)))
        .filter(F.col("_hit").isNotNull())
        .select(*[F.col(c) for c in series.columns], "_hit.cycle", "_hit.days_from_anchor")
    )


def normalise_at_anchor(
    sliced: DataFrame,
    value: str = "close",
    keys: Sequence[str] = (),
    date_col: str = "date",
    out: str = "normalised",
) -> DataFrame:
    """Divide by the value on the first available day at or after the anchor.

    The first ROW decides: when its value is NULL or not positive the cycle has no normalised series and
    is dropped. One window per (keys, cycle), bounded by the window length.
    """
    group = Window.partitionBy(*keys, "cycle")
    after = F.when(F.col("days_from_anchor") >= 0, F.col(date_col))
    return (
        sliced.withColumn("anchor_value", F.min_by(F.col(value), after).over(group))
        .filter(clean_double(F.col("anchor_value")) > 0)
        .withColumn(out, F.col(value) / F.col("anchor_value"))
    )


def base_cycles(
    series: DataFrame,
    cycles: Sequence[Cycle] = DEFAULT_CYCLES,
    value: str = "close",
    normalised: bool = True,
) -> DataFrame:
    """Cycles of the base asset, relative to the anchor or absolute."""
    sliced = cycle_slice(series.select("date", value), cycles)
    if not normalised:
        return sliced.select("cycle", "days_from_anchor", "date", value)
    return normalise_at_anchor(sliced, value).select(
        "cycle", "days_from_anchor", "date", value, "anchor_value", "normalised"
    )


def convert_quote(
    index: DataFrame,
    base: DataFrame,
    value: str = "index_price",
    rate: str = "close",
    out: str = "index_converted",
) -> DataFrame:
    """Index times the base asset's price of the same date; NULL where that price is missing."""
    rates = base.select("date", F.col(rate).alias("_rate"))
    return (
        index.join(rates, "date", "left").withColumn(out, F.col(value) * F.col("_rate")).drop("_rate")
    )


def index_cycles_dual(
    index: DataFrame,
    base: DataFrame,
    cycles: Sequence[Cycle] = DEFAULT_CYCLES,
    quotes: Sequence[str] = ("BTC", "USD"),
    first_cycle: int = 2,
    value: str = "index_price",
) -> DataFrame:
    """Normalised index cycles in the index's own quote and converted; early cycles are skipped.

    Both variants come from one converted series: each row is exploded into its two quotes and the quote
    is part of the normalisation key.
    """
    shown = [c for c in cycles if c.number >= first_cycle]
    variants = F.explode(
        F.array(
            F.struct(F.lit(quotes[0]).alias("quote"), F.col(value).alias("value")),
            F.struct(F.lit(quotes[1]).alias("quote"), F.col("index_converted").alias("value")),
        )
    )
    long = convert_quote(index, base, value).select("date", variants.alias("_v")).select("date", "_v.*")
    return normalise_at_anchor(cycle_slice(long, shown), "value", ["quote"]).select(
        "quote", "cycle", "days_from_anchor", "date", "value", "normalised"
    )


def top_members_label(composition: DataFrame, k: int = SUMMARY_TOP_N) -> DataFrame:
    """``A, B, C`` per date: the ``k`` best ranks PRESENT on it, upper case.

    A composition lists only priced members, so ranks may have holes. The group limit leaves ``k`` rows
    per date before the shuffle, which also bounds the list that is built.
    """
    order = Window.partitionBy("date").orderBy("rank")
    best = composition.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k)
    ranked = F.array_sort(F.collect_list(F.struct("rank", F.upper("coin_id").alias("coin"))))
    return best.groupBy("date").agg(
        F.array_join(F.transform(ranked, lambda m: m["coin"]), ", ").alias("top_members")
    )


def index_cycles_absolute(
    index: DataFrame,
    composition: DataFrame | None = None,
    cycles: Sequence[Cycle] = DEFAULT_CYCLES,
    first_cycle: int = 2,
    k: int = SUMMARY_TOP_N,
) -> DataFrame:
    """Index cycles in absolute values, with the leading members of each day where known."""
    shown = [c for c in cycles if c.number >= first_cycle]
    labelled = index
    if composition is not None:
        labelled = index.join(top_members_label(composition, k), "date", "left")
    return cycle_slice(labelled, shown)


def label_dates(
    rows: DataFrame, cycles: Sequence[Cycle] = DEFAULT_CYCLES, first_cycle: int = 2, date_col: str = "date"
) -> DataFrame:
    """Add ``cycle_label`` such as ``C2: Day 880 | C3: Day -5``; '' outside all cycles."""
    shown = [c for c in cycles if c.number >= first_cycle]
    return rows.withColumn("cycle_label", cycle_label(F.col(date_col), shown))
