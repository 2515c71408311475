"""From landed history pages to the price store."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import sanitise_id
from tidemark.operators.maintain import dedup_pages, fetch_plan, last_dates, legacy_to_move, prefer_pair_rows
from tidemark.params import HISTORY_FLOOR, QUOTES
from tidemark.schema import PRICES
from tidemark.session import materialise
from tidemark.sources.payloads import failed_pages, history_records, read_history_pages
from tidemark.sources.prices import (
    decode_pair_files,
    merge_into_store,
    pair_file_rows,
    read_pair_files,
    scan_prices,
    series_state,
    skipped_pair_files,
)


def plan_fetch(
    spark: SparkSession, entities: DataFrame, store: str | None, as_of: date, quotes=QUOTES, **options
) -> DataFrame:
    """Work list for a downloader. Without a store everything is fetched in full."""
    if store:
        last = series_state(spark, store).select("coin_id", "quote", "last_date")
    else:
        last = last_dates(spark.createDataFrame([], PRICES))
    return fetch_plan(entities, last, as_of, quotes, **options)


def merge_pages(
    spark: SparkSession,
    pages: DataFrame,
    store: str,
    start: date = HISTORY_FLOOR,
    full_refresh: bool = False,
) -> None:
    """Unnest, keep the first record per date, upsert. Failed and empty pages leave the store as it is.

    ``full_refresh`` replaces the fetched series instead of merging into them.
    """
    records = dedup_pages(history_records(pages, start)).select(*PRICES.fieldNames())
    merge_into_store(spark, store, records, replace=full_refresh)


def ingest_landing(
    spark: SparkSession, landing: str, store: str, start: date = HISTORY_FLOOR, full_refresh: bool = False
) -> DataFrame:
    """Merge a landing folder into the store; returns the failed pages."""
    pages = read_history_pages(spark, landing)
    merge_pages(spark, pages, store, start, full_refresh)
    return failed_pages(pages)


def import_pair_files(spark: SparkSession, folder: str, store: str) -> DataFrame:
    """Bring a file-per-pair folder into a store, trimmed like any other write; returns the files that were skipped.

    In an existing store the series of the folder are replaced and all others stay.
    """
    decoded = materialise(decode_pair_files(spark, folder), "pair-files")
    merge_into_store(spark, store, prefer_pair_rows(pair_file_rows(decoded)), replace=True)
    return skipped_pair_files(decoded)


def migrate_legacy_files(spark: SparkSession, folder: str, store: str) -> None:
    """Add the legacy series of a folder whose entities have no series in the default quote yet."""
    files = read_pair_files(spark, folder)
    legacy = files.filter("is_legacy").drop("is_legacy")
    added = legacy_to_move(scan_prices(spark, store), legacy.withColumn("coin_id", sanitise_id(F.col("coin_id"))))
    merge_into_store(spark, store, added.select(*PRICES.fieldNames()))
