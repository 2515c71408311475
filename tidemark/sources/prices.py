"""The price store: one long table, partitioned by quote and month.

Layout ``<path>/quote=BTC/month=2024-01/*.parquet``. A scan names its quote and dates and reads only the
partitions it needs; an increment reads and rewrites only the months it touches. ``<path>/_series`` holds one row per
series (first and last date, first positive close, first volume), so that neither an increment nor a
daily index has to look at the whole history. ``<path>/_months`` holds one row per series and month, from which fits
and coverage are merged. Ids are stored in their safe form, one row per key, NULL for NaN.

A write may end at any point. Both side tables count only where their write is known to be complete, and are made again from
the prices otherwise.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from datetime import date

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import clean_double, month_partition, pair_name_fields, sanitise_id
from tidemark.operators.maintain import PAIR, prefer_pair_rows, upsert_keep_last
from tidemark.params import DEFAULT_QUOTE
from tidemark.schema import OHLCV, PAIR_FILE_ROWS, PRICES
from tidemark.session import materialise
from tidemark.sources.files import delete_folder, is_complete, partitions_of, store_exists

_PARTITIONS = ("quote", "month")
_STORED = T.StructType(
    [f for f in PRICES.fields if f.name != "quote"]
    + [T.StructField(name, T.StringType(), True) for name in _PARTITIONS]
)


_DECODED = T.StructType([*PAIR_FILE_ROWS.fields, T.StructField("error", T.StringType(), True)])
_STATE = T.StructType(
    [T.StructField(name, T.StringType(), True) for name in PAIR]
    + [T.StructField(name, T.DateType(), True) for name in ("first_date", "first_close", "first_volume", "last_date")]
)


def _decode_pair_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of small parquet files given as bytes; a file that is not readable parquet gives one row with the error.

    A cell that is no number is NULL. Anything but a fault of the file itself fails the task.
    """
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            file = path.rsplit("/", 1)[-1]
            try:
                frame = pd.read_parquet(io.BytesIO(content))
                dates = pd.to_datetime(frame.index)
            except (pa.ArrowInvalid, OSError, ValueError) as error:  # not parquet, or its index holds no dates
                nothing = dict.fromkeys(_DECODED.fieldNames())
                yield pd.DataFrame([nothing | {"file": file, "error": str(error)[:500]}], dtype=object)
                continue
            rows = frame.reindex(columns=list(OHLCV)).apply(pd.to_numeric, errors="coerce").astype("float64")
            rows.insert(0, "date", dates.date)
            rows.insert(0, "file", file)
            yield rows.assign(error=None)


def decode_pair_files(
    spark: SparkSession, path: str, coins: Sequence[str] | None = None, quotes: Sequence[str] | None = None
) -> DataFrame:
    """Rows of all pair files, and a row with ``error`` for each that cannot be read.

    ``coins`` (in any form of the id) and ``quotes`` choose files by their names; Spark drops the others when it lists the folder, on any file system,
    and opens none of them. Legacy files count as files of the default quote.

    The files were saved from data frames one by one, so their physical types differ (nanosecond dates,
    whole numbers or doubles in the same column), which the parquet source cannot read under one
    schema. Spark lists and distributes the files, each of them tens of KB, and tasks decode them.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    coin, quote, _ = pair_name_fields(F.col("_metadata.file_name"))
    if coins is not None:
        files = files.filter(coin.isin([sanitise_id(F.lit(c)) for c in coins]))
    if quotes is not None:
        files = files.filter(quote.isin([q.upper() for q in quotes]))
    return files.select("path", "content").mapInPandas(_decode_pair_files, _DECODED)


def pair_file_rows(decoded: DataFrame) -> DataFrame:
    """``PRICES`` columns plus ``is_legacy`` of the readable files."""
    coin, quote, legacy = pair_name_fields(F.col("file"))
    return decoded.filter(F.col("error").isNull()).select(
        coin.alias("coin_id"),
        quote.alias("quote"),
        "date",
        *[clean_double(F.col(c)).alias(c) for c in OHLCV],
        legacy.alias("is_legacy"),
    )


def skipped_pair_files(decoded: DataFrame) -> DataFrame:
    """``file, error`` of the files that could not be read."""
    return decoded.filter(F.col("error").isNotNull()).select("file", "error")


def read_pair_files(
    spark: SparkSession, path: str, coins: Sequence[str] | None = None, quotes: Sequence[str] | None = None
) -> DataFrame:
    """Read the file-per-pair layout (``eth-btc.parquet``, legacy ``eth.parquet``) as long rows, of all or of some pairs.

    Unreadable files are skipped; ``skipped_pair_files`` lists them. Missing columns are NULL, NaN becomes
    NULL, dates are cut to the day. Result: ``PRICES`` columns plus ``is_legacy``.
    """
    return pair_file_rows(decode_pair_files(spark, path, coins, quotes))


def load_pair_files(
    spark: SparkSession, path: str, coins: Sequence[str] | None = None, quotes: Sequence[str] | None = None
) -> DataFrame:
    """Pair files as the reader sees them: a legacy file counts only where the pair file is absent."""
    return prefer_pair_rows(read_pair_files(spark, path, coins, quotes))


def get_prices(spark: SparkSession, path: str, coin: str, quote: str = DEFAULT_QUOTE) -> DataFrame:
    """The series of one pair in the file-per-pair layout, by date; its file, or the legacy one, is all that is opened."""
    rows = load_pair_files(spark, path, [coin], [quote])
    return rows.select(*PRICES.fieldNames()).orderBy("date")


def series_rows(prices: DataFrame, trim: bool = False) -> DataFrame:
    """Rows as the store holds them: safe ids, upper-case quotes, NULL for NaN, one row per key.

    Where ids become equal in their safe form, the row of the smaller original id stays. With ``trim`` rows
    before the first positive close of the stored series go. One shuffle and one sort by series.
    """
    rows = prices.select(
        sanitise_id(F.col("coin_id")).alias("coin_id"),
        F.upper("quote").alias("quote"),
        "date",
        *[clean_double(F.col(c)).alias(c) for c in OHLCV],
        F.col("coin_id").alias("_raw"),
    )
    series = Window.partitionBy(*PAIR).orderBy("date", "_raw", *[F.col(c).desc_nulls_last() for c in OHLCV])
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_one", ~F.lag("date").over(series).eqNullSafe(F.col("date")))
    keep = F.col("_one")
    if trim:
        first = F.min(F.when(F.col("_one") & (F.col("close") > 0), F.col("date"))).over(whole)
        rows = rows.withColumn("_first", first)
        keep = keep & (F.col("_first").isNull() | (F.col("date") >= F.col("_first")))
    return rows.filter(keep).select(*PRICES.fieldNames())


def _laid_out(stored: DataFrame) -> DataFrame:
    """Rows ready to be written, spread by partition, sorted within a file.

    ``rebalance`` is resolved by AQE from real sizes: a month that holds a large share of the rows is
    split over several tasks, small months share one. The sort gives row groups narrow id ranges.
    """
    rows = stored.select("coin_id", "date", *OHLCV, "quote", month_partition(F.col("date")).alias("month"))
    return rows.hint("rebalance", *[F.col(c) for c in _PARTITIONS]).sortWithinPartitions(
        *_PARTITIONS, "coin_id", "date"
    )


def _overwrite_partitions(laid_out: DataFrame, path: str) -> None:
    (
        laid_out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*_PARTITIONS)
        .parquet(path)
    )


def write_prices(prices: DataFrame, path: str, trim: bool = True) -> None:
    """Create a store from whole series. An existing store is refused: ``merge_into_store`` changes one."""
    spark = prices.sparkSession
    if store_exists(spark, path):
        raise FileExistsError(f"{path} exists; use merge_into_store")
    _overwrite_partitions(_laid_out(series_rows(prices, trim)), path)
    series_state(spark, path)
    month_summaries(spark, path)


def write_bucketed(prices: DataFrame, table: str, buckets: int) -> None:
    """A copy clustered by entity, for repeated index runs.

    Every window and aggregate by ``coin_id`` on this table reads its buckets without a shuffle.
    """
    (
        prices.select("coin_id", "date", *OHLCV, "quote")
        .write.mode("overwrite")
        .bucketBy(buckets, "coin_id")
        .sortBy("coin_id", "date")
        .saveAsTable(table)
    )


def scan_prices(
    spark: SparkSession,
    path: str,
    quote: str | None = None,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """Scan the store. Quote and date bounds prune partitions; further columns are pruned by Spark."""
    rows = spark.read.schema(_STORED).parquet(path)
    if quote:
        rows = rows.filter(F.col("quote") == quote.upper())
    if start:
        rows = rows.filter(
            (F.col("month") >= f"{start:%Y-%m}") & (F.col("date") >= F.lit(start))
        )
    if end:
        rows = rows.filter((F.col("month") <= f"{end:%Y-%m}") & (F.col("date") <= F.lit(end)))
    return rows.select(
        *[clean_double(F.col(c)).alias(c) if c in OHLCV else F.col(c) for c in PRICES.fieldNames()]
    )


def list_pairs(prices: DataFrame) -> DataFrame:
    """Distinct (coin_id, QUOTE), sorted."""
    return prices.select("coin_id", F.upper("quote").alias("quote")).distinct().orderBy("coin_id", "quote")


def list_coins(prices: DataFrame, quote: str | None = None) -> DataFrame:
    """Distinct entities, of one quote if given, sorted."""
    rows = prices.filter(F.upper("quote") == quote.upper()) if quote else prices
    return rows.select("coin_id").distinct().orderBy("coin_id")


def _months_of(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.upper("quote").alias("quote"), month_partition(F.col("date")).alias("month")
    ).distinct()


def _state_of(rows: DataFrame) -> DataFrame:
    day = F.col("date")
    return rows.groupBy(*PAIR).agg(
        F.min(day).alias("first_date"),
        F.min(F.when(F.col("close") > 0, day)).alias("first_close"),
        F.min(F.when(F.col("volume_to").isNotNull(), day)).alias("first_volume"),
        F.max(day).alias("last_date"),
    )


def series_state(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored series: ``coin_id, quote, first_date, first_close, first_volume, last_date``.

    Kept by every write. Where it is missing or its own write did not come to an end (another program wrote the store, or a
    write was cut short) it is made from one scan.
    """
    if not is_complete(spark, _state_path(path)):
        _state_of(scan_prices(spark, path)).write.mode("overwrite").parquet(_state_path(path))
    return spark.read.schema(_STATE).parquet(_state_path(path))


def _state_path(path: str) -> str:
    return f"{path}/_series"


_SUMMARY = T.StructType(
    [T.StructField("coin_id", T.StringType(), True), T.StructField("days", T.LongType(), True)]
    + [T.StructField(name, T.DateType(), True) for name in ("first_day", "last_day", "first_date", "last_date")]
    + [T.StructField("n", T.LongType(), True)]
    + [T.StructField(n, T.DoubleType(), True) for n in ("first", "last", "mean_x", "mean_y", "xx", "xy", "yy")]
    + [T.StructField(name, T.StringType(), True) for name in _PARTITIONS]
)


def _months_path(path: str) -> str:
    return f"{path}/_months"


def summarise(rows: DataFrame, value: str = "close") -> DataFrame:
    """One row per series and month, from which straight-line fits can be merged.

    ``days`` and ``first_day, last_day`` are of all rows; the rest of those with a ``value``: their number ``n``, first and last
    date and value, the means of x (days since 1970) and y, and the sums of squares and products around them.
    """
    x, y = F.unix_date("date").cast("double"), F.col(value)
    known = F.when(y.isNotNull(), F.col("date"))
    x = F.when(y.isNotNull(), x)
    month = month_partition(F.col("date")).alias("month")
    n = F.count(y)
    return rows.groupBy("coin_id", "quote", month).agg(
        F.count("*").alias("days"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        F.min(known).alias("first_date"),
        F.max(known).alias("last_date"),
        n.alias("n"),
        F.min_by(y, known).alias("first"),
        F.max_by(y, known).alias("last"),
        F.avg(x).alias("mean_x"),
        F.avg(y).alias("mean_y"),
        (F.var_pop(x) * n).alias("xx"),
        (F.covar_pop(x, y) * n).alias("xy"),
        (F.var_pop(y) * n).alias("yy"),
    ).select(*_SUMMARY.fieldNames())


def _write_summaries(rows: DataFrame, path: str) -> None:
    laid_out = summarise(rows).hint("rebalance", *[F.col(c) for c in _PARTITIONS]).sortWithinPartitions(*_PARTITIONS, "coin_id")
    _overwrite_partitions(laid_out, _months_path(path))


def month_summaries(spark: SparkSession, path: str) -> DataFrame:
    """``summarise`` of the whole store, kept by every write.

    A write removes the partitions it is about to change before it touches the prices. Those that the store has and this
    table lacks are made from a scan of just these months.
    """
    missing = set(partitions_of(spark, path, _PARTITIONS)) - set(partitions_of(spark, _months_path(path), _PARTITIONS))
    if missing:
        wanted = [dict(zip(_PARTITIONS, values)) for values in sorted(missing)]
        stored = _partitions(spark.read.schema(_STORED).parquet(path), wanted)
        _write_summaries(stored.select(*PRICES.fieldNames()), path)
    if not partitions_of(spark, _months_path(path), _PARTITIONS):
        return spark.createDataFrame([], _SUMMARY)
    return spark.read.schema(_SUMMARY).parquet(_months_path(path))


def _span_months(series: DataFrame) -> DataFrame:
    """(quote, month) of every month from the first to the last date of each series."""
    months = F.sequence(F.trunc("first_date", "MM"), F.col("last_date"), F.expr("interval 1 month"))
    return series.select("quote", F.explode(months).alias("_m")).select(
        "quote", month_partition(F.col("_m")).alias("month")
    ).distinct()


def merge_into_store(
    spark: SparkSession, path: str, delta: DataFrame, replace: bool = False, trim: bool = True
) -> None:
    """Upsert ``delta`` into the store: newest wins per date, with ``trim`` leading zeros trimmed.

    With ``replace`` the series in the delta take the place of the stored ones. Other series are left alone.
    Only the (quote, month) partitions that change are read and rewritten: the series state tells where
    stored series start. Only a series whose start can move to a later day is read as a whole: one without
    a positive close so far that gets one, one whose first positive close or first volume is overwritten by
    none, and one that starts before its first positive close, as a merge that was cut short may leave it. Running it twice
    with the same delta gives the same store. Replacement is per partition, not one transaction over all of them; side
    tables are removed first and written last, so that a merge that is cut short at any point is mended by the next one with
    the same delta. A store that does not exist yet is created. Without ``trim`` every row of a series stays, in a store that
    was made so as well.
    """
    if not store_exists(spark, path):
        write_prices(delta, path, trim)
        return
    keys = list(PAIR)
    delta = materialise(series_rows(delta), "delta")
    state = series_state(spark, path)
    arriving = _state_of(delta).select(*keys, F.col("first_close").alias("_close"))
    known = state.join(arriving, keys)
    if replace:
        whole = known.select(*_STATE.fieldNames())
    else:
        lost = (
            delta.join(state, keys)
            .filter(
                ((F.col("date") == F.col("first_close")) & ~F.coalesce(F.col("close") > 0, F.lit(False)))
                | ((F.col("date") == F.col("first_volume")) & F.col("volume_to").isNull())
            )
            .select(*_STATE.fieldNames())
        )
        gained = known.filter(F.col("first_close").isNull() & F.col("_close").isNotNull())
        untrimmed = known.filter(F.col("first_date") < F.col("first_close"))
        # Without trimming, a series is read as a whole only where its first close or volume is lost.
        starting = gained.union(untrimmed) if trim else known.limit(0)
        whole = lost.union(starting.select(*_STATE.fieldNames())).distinct()
    whole = materialise(whole, "whole-series")

    # One entry per (quote, month), like the folder listing itself, so they become literal partition filters.
    touched = _months_of(delta).union(_span_months(whole)).distinct().collect()
    current = _partitions(spark.read.schema(_STORED).parquet(path), touched).select(*PRICES.fieldNames())
    if replace:
        both = current.join(arriving, keys, "left_anti").unionByName(delta)
        starts = arriving.select(*keys, F.col("_close").alias("_first"))
    else:
        both = upsert_keep_last(current, delta)
        moved = _state_of(both.join(whole, keys, "left_semi")).select(*keys, F.col("first_close").alias("_first"))
        steady = (
            arriving.join(whole, keys, "left_anti")
            .join(state, keys, "left")
            .select(*keys, F.least("first_close", "_close").alias("_first"))
        )
        starts = moved.unionByName(steady)
    starts = materialise(starts.filter(F.col("_first").isNotNull() & F.lit(trim)), "starts")

    def from_start(rows: DataFrame) -> DataFrame:
        kept = rows.join(starts, keys, "left")
        return kept.filter(F.col("_first").isNull() | (F.col("date") >= F.col("_first"))).drop("_first")

    # Staged first: the partitions being replaced are also being read.
    staged = materialise(from_start(both), "merged")
    renewed = _state_of(staged.join(whole, keys, "left_semi"))
    grown = (
        state.join(arriving.join(whole, keys, "left_anti"), keys, "left_semi")
        .unionByName(_state_of(from_start(delta.join(whole, keys, "left_anti"))))
        .groupBy(*keys)
        .agg(*[F.min(c).alias(c) for c in ("first_date", "first_close", "first_volume")], F.max("last_date").alias("last_date"))
    )
    following = materialise(
        state.join(arriving, keys, "left_anti").unionByName(renewed).unionByName(grown), "series-state"
    )
    delete_folder(spark, _state_path(path))
    for row in touched:
        delete_folder(spark, f"{_months_path(path)}/quote={row['quote']}/month={row['month']}")
    _overwrite_partitions(_laid_out(staged), path)
    kept = {(r["quote"], r["month"]) for r in _months_of(staged).collect()}
    for row in touched:  # overwriting by partition leaves those in place whose last rows were trimmed
        if (row["quote"], row["month"]) not in kept:
            delete_folder(spark, f"{path}/quote={row['quote']}/month={row['month']}")
    _write_summaries(staged, path)
    following.write.mode("overwrite").parquet(_state_path(path))


def _partitions(rows: DataFrame, wanted: list) -> DataFrame:
    """Rows of the wanted (quote, month) partitions."""
    by_quote: dict[str, list[str]] = {}
    for row in wanted:
        by_quote.setdefault(row["quote"], []).append(row["month"])
    test = F.lit(False)
    for quote, months in by_quote.items():
        test = test | ((F.col("quote") == quote) & F.col("month").isin(months))
    return rows.filter(test)
