"""Incremental delivery of landed history pages with Structured Streaming.

The same merge as in batch, driven by a file stream: the checkpoint remembers which landing files were
merged, ``availableNow`` drains what has arrived and stops. The merge is an idempotent upsert by key in which the
newest fetch wins, so a batch that is replayed after a failure leaves the same store, and so does a backlog that
arrives in one batch; no watermark or state is needed. Error pages go to a side table.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.params import HISTORY_FLOOR
from tidemark.plans.history import merge_pages
from tidemark.session import shared_folder
from tidemark.sources.payloads import failed_pages, history_pages


def stream_history_pages(spark: SparkSession, landing: str, files_per_batch: int = 10_000) -> DataFrame:
    return history_pages(spark.readStream.option("maxFilesPerTrigger", files_per_batch), landing)


def deliver_landing(
    spark: SparkSession,
    landing: str,
    store: str,
    name: str = "landing",
    start: date = HISTORY_FLOOR,
    files_per_batch: int = 10_000,
    failed: str | None = None,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Merge every landing file that was not merged yet into the store, then stop.

    Pages that failed are kept in ``failed`` (by default ``<store>/_failed/<name>``), one folder per batch, so a
    replayed batch replaces its own. ``checkpoint`` must outlive the runs; the default is in the shared folder.
    """
    side = failed or f"{store}/_failed/{name}"

    def merge(batch: DataFrame, batch_id: int) -> None:
        failed_pages(batch).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
            f"{side}/batch={batch_id}"
        )
        merge_pages(batch.sparkSession, batch, store, start)

    return (
        stream_history_pages(spark, landing, files_per_batch)
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint or f"{shared_folder(spark)}/streams/{name}")
        .trigger(availableNow=True)
        .start()
    )
