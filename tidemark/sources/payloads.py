"""Landed JSON payloads: price history pages, ranking pages, symbol dictionary."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader

from tidemark.functions import clean_double, unix_date
from tidemark.params import HISTORY_FLOOR, RANKING_QUOTE, UNIVERSE_SIZE
from tidemark.schema import HISTORY_PAGE, RANKING_PAGE, SYMBOL_DICTIONARY, SYMBOL_INFO

# Landing file names: eth-btc-0003.json is page 3 of the history of eth in btc, eth-btc@20240105-0003.json the same of
# the fetch labelled 20240105 (labels sort by age), ranking-0002.json page 2 of the ranking
_HISTORY_NAME = r"^(.+)-([^-@]+)(?:@([0-9A-Za-z_]+))?-(\d+)\.json$"
_PAGE_NAME = r"(\d+)\.json$"
_CORRUPT = "_corrupt"


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType(), True)])


def _marked(pages: DataFrame, fault: Column) -> DataFrame:
    """Pages with a fault become error responses: their records are not used, and ``failed_pages`` lists them."""
    return pages.withColumns(
        {
            "Response": F.when(fault.isNotNull(), "Error").otherwise(F.col("Response")),
            "Message": F.coalesce(fault, F.col("Message")),
        }
    ).drop(_CORRUPT)


def history_pages(reader: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    """History pages with ``coin_id, quote, fetch, page`` taken from the file name, read in batch or as a stream.

    ``fetch`` is NULL without a label; ``fetched``, the day on which the file was last written, then orders fetches:
    unlabelled pages of one day count as one fetch. A page that is not valid JSON, and a file whose name does not
    fit, are error responses with a message.
    """
    name = F.col("_metadata.file_name")

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(name, _HISTORY_NAME, i), F.lit(""))

    pages = (
        reader.schema(_with_corrupt(HISTORY_PAGE))
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .option("pathGlobFilter", "*.json")
        .json(path)
        .select(
            F.coalesce(part(1), name).alias("coin_id"),
            F.upper(part(2)).alias("quote"),
            part(3).alias("fetch"),
            F.to_date("_metadata.file_modification_time").alias("fetched"),
            part(4).cast("int").alias("page"),
            "*",
        )
    )
    fault = F.when(F.col("page").isNull(), "File name is not that of a history page").when(
        F.col(_CORRUPT).isNotNull(), "Not valid JSON"
    )
    return _marked(pages, fault)


def read_history_pages(spark: SparkSession, path: str) -> DataFrame:
    return history_pages(spark.read, path)


def parse_history_pages(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """The same from a text column; other columns are kept."""
    others = [c for c in raw.columns if c != payload]
    options = {"columnNameOfCorruptRecord": _CORRUPT}
    parsed = F.from_json(payload, _with_corrupt(HISTORY_PAGE), options)
    return _marked(
        raw.select(*others, parsed.alias("_p")).select(*others, "_p.*"),
        F.when(F.col(_CORRUPT).isNotNull(), "Not valid JSON"),
    )


def failed_pages(pages: DataFrame) -> DataFrame:
    """Error responses and pages that could not be read, kept aside; the series they belong to stays as stored."""
    return pages.filter(F.col("Response") == "Error").drop("Data")


def history_records(pages: DataFrame, start: date = HISTORY_FLOOR) -> DataFrame:
    """Unnest pages to daily rows. Records without a time, or before ``start``, are dropped.

    The end of a fetch only steers paging; it does not filter. ``page`` and ``pos`` keep the order in
    which records were fetched; ``fetch`` and ``fetched`` of the landing reader tell fetches apart. NaN is NULL.
    """
    labels = [c for c in ("fetch", "fetched") if c in pages.columns]
    floor = datetime.combine(start, datetime.min.time(), timezone.utc).timestamp()
    record = F.col("_r")
    return (
        pages.filter(F.col("Response").isNull() | (F.col("Response") != "Error"))
        .select("coin_id", "quote", *labels, "page", F.posexplode("Data.Data").alias("pos", "_r"))
        .filter(record["time"] >= F.lit(int(floor)))
        .select(
            "coin_id",
            "quote",
            unix_date(record["time"]).alias("date"),
            *[clean_double(record[c]).alias(c) for c in ("open", "high", "low", "close")],
            clean_double(record["volumefrom"]).alias("volume_from"),
            clean_double(record["volumeto"]).alias("volume_to"),
            *labels,
            "page",
            "pos",
        )
    )


def read_ranking_pages(spark: SparkSession, path: str) -> DataFrame:
    name = F.col("_metadata.file_name")
    return (
        spark.read.schema(RANKING_PAGE)
        .option("multiLine", True)
        .option("pathGlobFilter", "*.json")
        .json(path)
        .select(F.regexp_extract(name, _PAGE_NAME, 1).cast("int").alias("page"), "Data")
    )


def ranked_entities(pages: DataFrame, n: int = UNIVERSE_SIZE, quote: str = RANKING_QUOTE) -> DataFrame:
    """First ``n`` entities in page order that have data in ``quote``, ranked 1..n.

    The cut comes before the rank: sort and limit run as a distributed top-n, and only the ``n``
    survivors are numbered.
    """
    raw = F.try_element_at(F.col("_r.RAW"), F.lit(quote.upper()))

    def number(field: str) -> Column:
        return F.coalesce(F.try_element_at(raw, F.lit(field)).cast("double"), F.lit(0.0))

    symbol = F.coalesce(F.col("_r.CoinInfo.Name"), F.lit(""))
    return (
        pages.select("page", F.posexplode("Data").alias("pos", "_r"))
        .filter(raw.isNotNull() & (F.size(raw) > 0))
        .select(
            "page",
            "pos",
            F.lower(symbol).alias("id"),
            symbol.alias("symbol"),
            F.coalesce(F.col("_r.CoinInfo.FullName"), F.lit("")).alias("name"),
            number("MKTCAP").alias("market_cap"),
            number("PRICE").alias("current_price"),
            number("VOLUME24HOUR").alias("volume_24h"),
            number("CIRCULATINGSUPPLY").alias("circulating_supply"),
        )
        .orderBy("page", "pos")
        .limit(n)
        .withColumn("market_cap_rank", F.expr("row_number() over (order by page, pos)"))
        .select(
            "id",
            "symbol",
            "name",
            "market_cap",
            "market_cap_rank",
            "current_price",
            "volume_24h",
            "circulating_supply",
        )
    )


def read_symbol_dictionary(spark: SparkSession, path: str) -> DataFrame:
    pages = spark.read.schema(SYMBOL_DICTIONARY).option("multiLine", True).json(path)
    return symbol_rows(pages.select("Data"))


def symbol_rows(pages: DataFrame, column: str = "Data") -> DataFrame:
    """One row per entry of a symbol map: the key, then the fields of its info."""
    return pages.select(F.explode(column).alias("key", "_info")).select(
        "key", *[F.col(f"_info.{f}").alias(f) for f in SYMBOL_INFO.fieldNames()]
    )


def parse_symbol_maps(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Symbol rows from a text column that holds ``{symbol: info}`` maps."""
    kind = T.MapType(T.StringType(), SYMBOL_INFO)
    return symbol_rows(raw.select(F.from_json(payload, kind).alias("Data")))
