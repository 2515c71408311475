"""Stored results: the index and its composition."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import month_partition
from tidemark.operators.index import IndexResult, within
from tidemark.schema import COMPOSITION, INDEX
from tidemark.session import materialise
from tidemark.sources.files import delete_folder, store_exists

_MONTH = T.StructField("month", T.StringType(), True)
_STORED_COMPOSITION = T.StructType([*COMPOSITION.fields, _MONTH])


def write_index(index: DataFrame, path: str) -> None:
    """One row per date, hence small; replaced as a whole."""
    index.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Fails when no index was written."""
    return spark.read.schema(INDEX).parquet(path)


def _write_months(rows: DataFrame, path: str, mode: str) -> None:
    (
        rows.hint("rebalance", F.col("month"))
        .sortWithinPartitions("month", "date", "rank")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", mode)
        .partitionBy("month")
        .parquet(path)
    )


def write_composition(composition: DataFrame, path: str) -> bool:
    """Partitioned by month so that reports prune; nothing is written when there are no rows."""
    if composition.isEmpty():
        return False
    _write_months(composition.withColumn("month", month_partition(F.col("date"))), path, "static")
    return True


def read_composition(spark: SparkSession, path: str, month: str | None = None) -> DataFrame:
    """Composition, of one ``yyyy-MM`` month if given; fails when none was written."""
    rows = spark.read.schema(_STORED_COMPOSITION).parquet(path)
    if month:
        rows = rows.filter(F.col("month") == month)
    return rows.select(*COMPOSITION.fieldNames())


def write_index_range(index: DataFrame, path: str, start: date | None, end: date | None) -> None:
    """Replace the dates of a range, both ends included; what is stored outside it stays."""
    spark = index.sparkSession
    if (start or end) and store_exists(spark, path):
        stored = read_index(spark, path)
        index = stored.filter(~within(F.col("date"), start, end)).unionByName(index.select(*INDEX.fieldNames()))
        index = materialise(index, "index")  # the table being replaced is also being read
    write_index(index, path)


def write_composition_range(composition: DataFrame, path: str, start: date | None, end: date | None) -> bool:
    """The same for the composition. Only the months that hold old or new rows of the range are rewritten."""
    spark = composition.sparkSession
    if not (start or end) or not store_exists(spark, path):
        return write_composition(composition, path)
    stored = spark.read.schema(_STORED_COMPOSITION).parquet(path)
    months = F.lit(True)
    if start:
        months = months & (F.col("month") >= f"{start:%Y-%m}")
    if end:
        months = months & (F.col("month") <= f"{end:%Y-%m}")
    kept = stored.filter(months & ~within(F.col("date"), start, end))
    fresh = composition.withColumn("month", month_partition(F.col("date")))
    columns = _STORED_COMPOSITION.fieldNames()
    merged = materialise(kept.select(*columns).unionByName(fresh.select(*columns)), "composition")
    # One entry per month, like the folder listing itself.
    before = {r["month"] for r in stored.filter(months).select("month").distinct().collect()}
    after = {r["month"] for r in merged.select("month").distinct().collect()}
    _write_months(merged, path, "dynamic")
    for month in before - after:
        delete_folder(spark, f"{path}/month={month}")
    return bool(after)


def write_result(
    result: IndexResult, index_path: str, composition_path: str, start: date | None = None, end: date | None = None
) -> None:
    """Store index and composition; of a run over a range of dates only that range is replaced."""
    write_index_range(result.index, index_path, start, end)
    write_composition_range(result.composition, composition_path, start, end)
