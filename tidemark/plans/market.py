"""From the price store to index, composition and the tables behind the charts."""

from __future__ import annotations

from calendar import monthrange
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import day_number
from tidemark.operators import report
from tidemark.operators.classify import index_rows
from tidemark.operators.cycles import (
    DEFAULT_CYCLES,
    Cycle,
    base_cycles,
    index_cycles_absolute,
    index_cycles_dual,
    label_dates,
)
from tidemark.operators.index import IndexResult, compute_index, in_range
from tidemark.operators.trend import linear_trend_from_months
from tidemark.params import DEFAULT_QUOTE, DEFAULT_RULES, INDEX_TOP_N, TREND_MIN_POINTS, TREND_START, VOLUME_WINDOW, RuleSet
from tidemark.session import materialise
from tidemark.sources.prices import month_summaries, scan_prices, series_state, summarise
from tidemark.sources.results import read_composition, read_index, write_result


class NoDataError(ValueError):
    """Nothing to compute from."""


def eligible_series(series: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """``coin_id, first_volume`` of the stored series that may enter the index, written once.

    One row per series, so the rules run once for each; raises when there are no series, or none that may.
    """
    if series.isEmpty():
        raise NoDataError("No cached price data found")
    eligible = materialise(index_rows(series, rules).select("coin_id", "first_volume"), "eligible")
    if eligible.isEmpty():
        raise NoDataError("No eligible coins found")
    return eligible


def build_index(
    spark: SparkSession,
    store: str,
    index_path: str | None = None,
    composition_path: str | None = None,
    quote: str = DEFAULT_QUOTE,
    top_n: int = INDEX_TOP_N,
    window: int = VOLUME_WINDOW,
    start: date | None = None,
    end: date | None = None,
    rules: RuleSet = DEFAULT_RULES,
    price_mask: str = "reference",
    entities: Sequence[str] | None = None,
) -> IndexResult:
    """Compute the index from the store and, where paths are given, write both results.

    ``entities`` restricts the universe (a short list; longer ones belong in a semi-join before). With
    ``start`` or ``end`` only these dates are replaced in the stored results, and only the days that smoothing
    needs are read from the store: this is the daily run.
    """
    series = series_state(spark, store).filter(F.col("quote") == quote.upper())
    if entities is not None:
        series = series.filter(F.col("coin_id").isin(list(entities)))
    eligible = eligible_series(series, rules)
    # The days before ``start`` that smoothing needs, and no more.
    prices = scan_prices(spark, store, quote, start - timedelta(days=window - 1) if start else None, end)
    result = compute_index(
        prices.join(eligible.select("coin_id"), "coin_id", "left_semi"),
        top_n,
        window,
        start,
        end,
        price_mask=price_mask,
        first_volume=eligible.select("coin_id", day_number(F.col("first_volume")).alias("_first")),
        entities=eligible,
    )
    if result.index.isEmpty():
        raise NoDataError("Could not calculate the index for any date")
    if index_path and composition_path:
        write_result(result, index_path, composition_path, start, end)
        # Hand back what was written instead of a plan that computes it again.
        stored = in_range(read_index(spark, index_path), start, end)
        members = result.composition
        if not members.isEmpty():
            members = in_range(read_composition(spark, composition_path), start, end)
        result = IndexResult(stored, members, result.stats)
    return result


def chart_tables(
    index: DataFrame,
    composition: DataFrame,
    base: DataFrame,
    cycles: Sequence[Cycle] = DEFAULT_CYCLES,
) -> dict[str, DataFrame]:
    """The series behind each chart and report page. ``base`` is the base asset in the second quote."""
    return {
        "base_normalised": base_cycles(base, cycles),
        "base_absolute": base_cycles(base, cycles, normalised=False),
        "index_dual": index_cycles_dual(index, base, cycles),
        "index_absolute": index_cycles_absolute(index, composition, cycles),
        "months": report.months(composition),
        "month_rows": report.month_rows(composition, index),
        "dates": label_dates(composition.select("date").distinct(), cycles),
        "changes": report.membership_summary(composition),
        "day_totals": report.day_totals(composition),
        "grid": report.availability_grid(composition),
    }


def stored_trend(
    spark: SparkSession,
    path: str,
    quote: str,
    start: date = TREND_START,
    as_of: date | None = None,
    min_points: int = TREND_MIN_POINTS,
    base: str = "series",
) -> DataFrame:
    """``linear_trend`` of a stored quote from its month summaries.

    Of the prices only the months are read that the window cuts: none, if it starts on the first day of a month and has no end
    or ends on the last of one.
    """
    months = month_summaries(spark, path).filter(F.col("quote") == quote.upper())
    edges = None
    for low, high in _cut_months(start, as_of):
        part = summarise(scan_prices(spark, path, quote, low, high))
        edges = part if edges is None else edges.unionByName(part)
    return linear_trend_from_months(months, start, as_of, min_points, edges, base)


def _cut_months(start: date, as_of: date | None) -> list[tuple[date, date]]:
    """The parts of months at both ends of [start, as_of]; one part if both ends lie in one month."""
    last = as_of or date.max
    month_end = start.replace(day=monthrange(start.year, start.month)[1])
    parts = [(start, min(month_end, last))] if start.day > 1 or last < month_end else []
    if as_of and as_of > month_end and as_of.day < monthrange(as_of.year, as_of.month)[1]:
        parts.append((as_of.replace(day=1), as_of))
    return [(low, high) for low, high in parts if low <= high]


def stored_coverage(spark: SparkSession, path: str, quote: str | None = None) -> DataFrame:
    """``operators.index.coverage`` of a store from its month summaries; no price file is read."""
    months = month_summaries(spark, path)
    keys = ["coin_id"] if quote else ["coin_id", "quote"]
    rows = months.filter(F.col("quote") == quote.upper()) if quote else months
    return rows.groupBy(*keys).agg(
        F.min("first_day").alias("start_date"), F.max("last_day").alias("end_date"), F.sum("days").alias("days")
    )
