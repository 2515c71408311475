"""Trailing means on the stream of landed pages: state per series, corrected in any order of arrival."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import date
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.params import HISTORY_FLOOR, VOLUME_WINDOW
from tidemark.session import shared_folder
from tidemark.sources.payloads import history_records
from tidemark.streaming.landing import stream_history_pages

MEANS = "coin_id string, quote string, date date, mean double"
_STATE = "days binary, amounts binary, ranks string"
_EPOCH = np.datetime64("1970-01-01")


def fetch_rank(fetch: Column, fetched: Column, page: Column, pos: Column) -> Column:
    """A text that is greatest for the record that counts: the newest fetch, and in it the first page and place."""
    most = F.lit(10**9 - 1)
    parts = [F.coalesce(fetch, F.lit("")), F.coalesce(fetched.cast("string"), F.lit(""))]
    return F.concat_ws("|", *parts, *[F.lpad((most - c).cast("string"), 9, "0") for c in (page, pos)])


def _means(days: np.ndarray, amounts: np.ndarray, window: int) -> np.ndarray:
    """Mean over the last ``window`` calendar days at each of the ascending days, NaN unless all of them have an amount."""
    out = np.full(len(days), np.nan)
    if len(days) >= window:
        parts = np.lib.stride_tricks.sliding_window_view(amounts, window).mean(axis=1)
        whole = days[window - 1 :] - days[: len(days) - window + 1] == window - 1
        out[window - 1 :] = np.where(whole, parts, np.nan)
    return out


def _update(
    key: tuple, frames: Iterable[pd.DataFrame], state: GroupState, window: int, keep_days: int | None, idle_ms: int | None
) -> Iterator[pd.DataFrame]:
    """Overlay the days of a series with the new records, and give the means of all days that these reach."""
    if state.hasTimedOut:
        state.remove()
        return
    held: dict[int, tuple[str, float]] = {}
    if state.exists:
        days, amounts, ranks = state.get
        held = dict(zip(np.frombuffer(days, np.int32).tolist(), zip(ranks.split("\n"), np.frombuffer(amounts).tolist())))
    oldest = None if keep_days is None or not held else max(held) - keep_days
    changed = set()
    for frame in frames:
        for day, rank, amount in zip(frame["day"].tolist(), frame["rank"].tolist(), frame["amount"].tolist()):
            if (oldest is None or day > oldest) and (day not in held or rank > held[day][0]):
                held[day] = (rank, float("nan") if amount is None else amount)
                changed.add(day)
    days = np.array(sorted(held), np.int32)
    amounts = np.array([held[d][1] for d in days.tolist()])
    # The window of the oldest day that can still change needs the days before it.
    kept = slice(0 if keep_days is None or not held else int(np.searchsorted(days, days[-1] - keep_days - window + 2)), None)
    ranks = "\n".join(held[d][0] for d in days[kept].tolist())
    state.update((days[kept].tobytes(), amounts[kept].tobytes(), ranks))
    if idle_ms is not None:
        state.setTimeoutDuration(idle_ms)
    if not changed:
        return
    recent = np.array(sorted(changed))
    before = np.searchsorted(recent, days, "right")
    reached = (before > 0) & (days - recent[np.maximum(before - 1, 0)] < window)
    means = _means(days, amounts, window)[reached]
    dates = (_EPOCH + days[reached].astype("timedelta64[D]")).astype("datetime64[D]").astype(object)
    yield pd.DataFrame({"coin_id": key[0], "quote": key[1], "date": dates, "mean": pd.Series(means).astype(object).where(~np.isnan(means), None)})


def trailing_means(
    pages: DataFrame,
    window: int = VOLUME_WINDOW,
    value: str = "volume_to",
    start: date = HISTORY_FLOOR,
    keep_days: int | None = None,
    idle_ms: int | None = None,
) -> DataFrame:
    """``coin_id, quote, date, mean`` of every day whose trailing mean a batch of the stream of pages changes.

    A later row for the same day takes the place of an earlier one. What is left equals ``operators.rolling.rolling_volume`` over
    all pages at once, in whatever order they arrive: of several records of a day that of the newest fetch counts, as in
    ``operators.maintain.dedup_pages``, and a correction changes the means of the days behind it.

    The state of a series is one amount and one rank per day. ``keep_days`` bounds it: records that are older than the newest
    day by so many days or more are then dropped. A series without pages for ``idle_ms`` is forgotten.
    """
    records = history_records(pages, start)
    day = F.unix_date("date")
    rank = fetch_rank(F.col("fetch"), F.col("fetched"), F.col("page"), F.col("pos"))
    rows = records.select("coin_id", "quote", day.alias("day"), rank.alias("rank"), F.col(value).alias("amount"))
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    update = partial(_update, window=window, keep_days=keep_days, idle_ms=idle_ms)
    return rows.groupBy("coin_id", "quote").applyInPandasWithState(update, MEANS, _STATE, "update", timeout)


def deliver_trailing_means(
    spark: SparkSession,
    landing: str,
    path: str,
    name: str = "trailing-means",
    window: int = VOLUME_WINDOW,
    files_per_batch: int = 10_000,
    checkpoint: str | None = None,
    **options,
) -> StreamingQuery:
    """Bring the means below ``path`` up to date with the landing folder, then stop; ``read_trailing_means`` reads them.

    Each batch writes the means it changes to a folder of its own, so a batch that is replayed replaces its own rows.
    """
    means = trailing_means(stream_history_pages(spark, landing, files_per_batch), window, **options)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/batch={batch_id}")

    return (
        means.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint or f"{shared_folder(spark)}/streams/{name}")
        .trigger(availableNow=True)
        .start()
    )


def read_trailing_means(spark: SparkSession, path: str) -> DataFrame:
    """The newest mean of every day; one partial aggregate per batch folder before the shuffle."""
    rows = spark.read.schema(f"{MEANS}, batch long").parquet(path)
    return rows.groupBy("coin_id", "quote", "date").agg(F.max_by(F.struct("mean"), "batch")["mean"].alias("mean"))
