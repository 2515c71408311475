"""Entity lists: accepted entities as JSON, skipped entities as ';'-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import ENTITY, SKIPPED
from tidemark.params import SKIPPED_HEADER

_LISTED = T.StructType([*ENTITY.fields, T.StructField("position", T.LongType(), True)])


def write_entities(entities: DataFrame, path: str) -> None:
    """JSON lines. A ``position`` column, where present, keeps the order of the list."""
    entities.write.mode("overwrite").json(path)


def read_entities(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Accepted entities; fails when the list does not exist.

    ``multi_line`` reads a file that is one JSON array. Its order is then recorded in ``position``.
    """
    if not multi_line:
        return spark.read.schema(_LISTED).json(path)
    array = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.from_json("value", T.ArrayType(ENTITY))).alias("_pos", "_e")
    )
    return array.select("_e.*", (F.col("_pos") + 1).cast("long").alias("position"))


def write_skipped(skipped: DataFrame, path: str) -> None:
    """Ordered by id over all part files; every part starts with the header.

    Only fields that need it are quoted, and quotes are doubled inside. The row number keeps rows of one
    id in their order and lets the sort spread an id with very many rows over several tasks.
    """
    numbered = skipped.withColumn("_row", F.monotonically_increasing_id())
    named = numbered.orderBy("coin_id", "_row").select(
        *[F.col(c).alias(title) for c, title in zip(SKIPPED.fieldNames(), SKIPPED_HEADER)]
    )
    (
        named.write.mode("overwrite")
        .option("sep", ";")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_skipped(spark: SparkSession, path: str) -> DataFrame:
    """Lines after the header that have at least five ';'-separated fields; quotes mean nothing.

    Each line is read as one field (no separator occurs in it), then split.
    """
    lines = (
        spark.read.schema("line STRING")
        .option("sep", "\u0001")
        .option("header", True)
        .option("quote", "")
        .csv(path)
    )
    fields = F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), ";")
    return lines.filter(F.size(fields) >= 5).select(
        *[fields[i].alias(c) for i, c in enumerate(SKIPPED.fieldNames())]
    )
