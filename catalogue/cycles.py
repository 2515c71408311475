"""Event-cycle queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.registry import query
from catalogue.views import (
    CYCLES,
    SQL_CYCLES,
    SQL_LIN,
    SQL_ORD,
    orders_daily,
    shipping_daily,
    sql_members,
    table,
)
from tidemark.operators import cycles as cy
from tidemark.operators.index import compute_index, weighted_index

WINDOW, TOP_N = 7, 4
SQL_SHIPPING_INDEX = sql_members(SQL_LIN, WINDOW, TOP_N)


def sql_slice(series: str, columns: str) -> str:
    return f"""SELECT {columns}, c.cycle, CAST(datediff('day', c.a, x.date) AS INTEGER) AS days_from_anchor
    FROM ({series}) x JOIN ({SQL_CYCLES}) c ON x.date BETWEEN c.s AND c.e"""


def sql_normalised(sliced: str, keys: str, value: str) -> str:
    """Rows of ``sliced`` with ``anchor_value`` and ``normalised``; the first row at or after the anchor decides."""
    return f"""
    SELECT s.*, b.base AS anchor_value, s.{value} / b.base AS normalised
    FROM ({sliced}) s JOIN (
      SELECT {keys}, {value} AS base FROM ({sliced}) WHERE days_from_anchor >= 0
      QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY date) = 1) b USING ({keys})
    WHERE b.base > 0"""


@query(
    "c01_cycle_dimension",
    f"""SELECT c.cycle, c.s AS start_date, c.a AS anchor_date, c.e AS end_date, count(o.date) AS n_days
    FROM ({SQL_CYCLES}) c LEFT JOIN ({SQL_ORD}) o ON o.date BETWEEN c.s AND c.e GROUP BY ALL""",
)
def c01_cycle_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cy.cycle_slice(orders_daily(spark, sf_dir), CYCLES).groupBy("cycle").agg(F.count("date").alias("n_days"))
    return cy.cycle_dimension(spark, CYCLES).join(counts, "cycle", "left").fillna(0, ["n_days"])


@query("c02_slice", sql_slice(SQL_ORD, "x.date, x.close"))
def c02_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cy.cycle_slice(orders_daily(spark, sf_dir).select("date", "close"), CYCLES)


# Prices that are missing or not positive on some days, so that the first row at the anchor matters
_SQL_HOLES = f"""SELECT coin_id, date,
    CASE WHEN day(date) = 15 AND coin_id = 'af' THEN NULL WHEN day(date) = 1 AND coin_id = 'ro' THEN 0.0::DOUBLE
         ELSE close END AS close FROM ({SQL_LIN})"""


def _holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, coin = F.dayofmonth("date"), F.col("coin_id")
    return shipping_daily(spark, sf_dir).select(
        "coin_id",
        "date",
        F.when((day == 15) & (coin == "af"), None)
        .when((day == 1) & (coin == "ro"), 0.0)
        .otherwise(F.col("close"))
        .alias("close"),
    )


@query(
    "c04_normalised",
    f"""SELECT coin_id, cycle, days_from_anchor, date, close, anchor_value, round(normalised, 9) AS normalised
    FROM ({sql_normalised(sql_slice(_SQL_HOLES, "x.coin_id, x.date, x.close"), "coin_id, cycle", "close")})""",
)
def c04_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    sliced = cy.cycle_slice(_holes(spark, sf_dir), CYCLES)
    return cy.normalise_at_anchor(sliced, "close", ["coin_id"]).withColumn("normalised", F.round("normalised", 9))


_SQL_BASE = sql_slice(SQL_ORD, "x.date, x.close")


@query(
    "c05_base_normalised",
    f"""SELECT cycle, days_from_anchor, date, close, anchor_value, round(normalised, 9) AS normalised
    FROM ({sql_normalised(_SQL_BASE, "cycle", "close")})""",
)
def c05_base_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cy.base_cycles(orders_daily(spark, sf_dir), CYCLES)
    return rows.withColumn("normalised", F.round("normalised", 9))


@query("c06_base_absolute", f"SELECT cycle, days_from_anchor, date, close FROM ({_SQL_BASE})")
def c06_base_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cy.base_cycles(orders_daily(spark, sf_dir), CYCLES, normalised=False)


def shipping_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_index(shipping_daily(spark, sf_dir), TOP_N, WINDOW)


def urgent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base series with missing days."""
    return (
        table(spark, sf_dir, "orders")
        .filter(F.col("o_orderpriority") == "1-URGENT")
        .groupBy(F.to_date("o_orderdate").alias("date"))
        .agg(
            (
                F.sum(F.rint(F.col("o_totalprice") * 100).cast("bigint")) / F.count(F.lit(1)) / F.lit(100.0)
            ).alias("close")
        )
    )


_SQL_URGENT = """
    SELECT CAST(o_orderdate AS DATE) AS date,
      CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0::DOUBLE AS close
    FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL"""
_SQL_CONVERTED = f"""
    SELECT i.date, i.index_price, i.index_price * u.close AS index_converted
    FROM idx i LEFT JOIN ({_SQL_URGENT}) u USING (date)"""


@query(
    "c07_convert",
    f"""WITH {SQL_SHIPPING_INDEX}
    SELECT date, round(index_price, 4) AS index_price, round(index_converted, 0) AS index_converted
    FROM ({_SQL_CONVERTED})""",
)
def c07_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cy.convert_quote(shipping_index(spark, sf_dir), urgent_orders(spark, sf_dir))
    return rows.select(
        "date",
        F.round("index_price", 4).alias("index_price"),
        F.round("index_converted", 0).alias("index_converted"),
    )


_SQL_DUAL = f"""
    SELECT 'BTC' AS quote, date, index_price AS value FROM ({_SQL_CONVERTED})
    UNION ALL SELECT 'USD', date, index_converted FROM ({_SQL_CONVERTED})"""
_SQL_DUAL_SLICE = sql_slice(_SQL_DUAL, "x.quote, x.date, x.value") + " WHERE c.cycle >= 2"


@query(
    "c08_dual",
    f"""WITH {SQL_SHIPPING_INDEX}
    SELECT quote, cycle, days_from_anchor, date, round(normalised, 8) AS normalised
    FROM ({sql_normalised(_SQL_DUAL_SLICE, "quote, cycle", "value")})""",
)
def c08_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cy.index_cycles_dual(shipping_index(spark, sf_dir), urgent_orders(spark, sf_dir), CYCLES)
    return rows.drop("value").withColumn("normalised", F.round("normalised", 8))


@query(
    "c09_top_members",
    f"""WITH {SQL_SHIPPING_INDEX},
    top AS (SELECT date, string_agg(upper(coin_id), ', ' ORDER BY rank) AS top_members FROM (
      SELECT * FROM comp QUALIFY row_number() OVER (PARTITION BY date ORDER BY rank) <= 3) GROUP BY date)
    {sql_slice("SELECT i.*, t.top_members FROM idx i LEFT JOIN top t USING (date)",
               "x.date, round(x.index_price, 4) AS index_price, x.coin_count, x.top_members")}
    WHERE c.cycle >= 2""",
)
def c09_top_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = compute_index(shipping_daily(spark, sf_dir), TOP_N, WINDOW)
    rows = cy.index_cycles_absolute(result.index, result.composition, CYCLES, k=3)
    return rows.drop("total_volume").withColumn("index_price", F.round("index_price", 4))


@query(
    "c10_labels",
    f"""SELECT o.date, coalesce(string_agg('C' || c.cycle || ': Day ' || datediff('day', c.a, o.date), ' | '
             ORDER BY c.cycle), '') AS cycle_label
    FROM ({SQL_ORD}) o LEFT JOIN ({SQL_CYCLES}) c ON o.date BETWEEN c.s AND c.e AND c.cycle >= 2 GROUP BY o.date""",
)
def c10_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cy.label_dates(orders_daily(spark, sf_dir).select("date"), CYCLES)
