"""Composition and status report queries.

Reports read a stored composition. These queries compute it once, write it to the shared folder and
read it back, because a report looks at it several times.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.cycles import SQL_SHIPPING_INDEX
from catalogue.cycles import TOP_N as SHIP_TOP_N
from catalogue.cycles import WINDOW as SHIP_WINDOW
from catalogue.filters import SQL_CLASSIFIED, classified_parts
from catalogue.index import SQL_INDEX, TOP_N, WINDOW
from catalogue.registry import query
from catalogue.views import SQL_EV, SQL_EVQ, SQL_PRT, events_daily, events_daily_by_type, parts, shipping_daily, table
from tidemark.functions import magnitude_label
from tidemark.operators import report as rp
from tidemark.operators.classify import skipped
from tidemark.operators.index import IndexResult, compute_index, coverage, weighted_index

DAY = date(2024, 1, 20)


def events_result(spark: SparkSession, sf_dir: str) -> IndexResult:
    return compute_index(events_daily(spark, sf_dir), TOP_N, WINDOW)


def shipping_result(spark: SparkSession, sf_dir: str) -> IndexResult:
    return compute_index(shipping_daily(spark, sf_dir), SHIP_TOP_N, SHIP_WINDOW)


@query(
    "r01_months",
    f"""WITH {SQL_SHIPPING_INDEX}
    SELECT DISTINCT strftime(date, '%Y_%m') AS month, strftime(date, '%b %Y') AS month_label,
      strftime(date, '%Y_%m') = (SELECT max(strftime(date, '%Y_%m')) FROM comp) AS is_latest FROM comp""",
)
def r01_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.months(shipping_result(spark, sf_dir).composition)


@query(
    "r02_month_rows",
    f"""WITH {SQL_SHIPPING_INDEX}
    SELECT strftime(c.date, '%Y_%m') AS month, c.date, CAST(c.rank AS INTEGER) AS rank, upper(c.coin_id) AS coin_id,
      round(c.volume, 4) AS volume, round(c.weight * 100, 6) AS weight_pct, c.price, round(i.index_price, 4) AS index_price
    FROM comp c LEFT JOIN (SELECT * FROM idx WHERE day(date) <> 13) i USING (date)""",
)
def r02_month_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = shipping_result(spark, sf_dir)
    rows = rp.month_rows(result.composition, result.index.filter(F.dayofmonth("date") != 13))
    return (
        rows.withColumn("volume", F.round("volume", 4))
        .withColumn("weight_pct", F.round("weight_pct", 6))
        .withColumn("index_price", F.round("index_price", 4))
    )


@query(
    "r03_previous_dates",
    f"""WITH {SQL_SHIPPING_INDEX}, d AS (SELECT DISTINCT date FROM comp),
    p AS (SELECT date, lag(date) OVER (ORDER BY date) AS previous_date FROM d)
    SELECT date, previous_date, coalesce(strftime(previous_date, '%Y_%m') <> strftime(date, '%Y_%m'), FALSE) AS carried_over FROM p""",
)
def r03_previous_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.previous_dates(shipping_result(spark, sf_dir).composition)


_CHANGES = """
    d AS (SELECT DISTINCT date FROM comp),
    p AS (SELECT date, lag(date) OVER (ORDER BY date) AS previous_date FROM d),
    ch AS (
      SELECT p.date, 'added' AS change, c.coin_id, c.rank FROM p JOIN comp c ON c.date = p.date
      WHERE p.previous_date IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM comp q WHERE q.date = p.previous_date AND q.coin_id = c.coin_id)
      UNION ALL
      SELECT p.date, 'removed', c.coin_id, c.rank FROM p JOIN comp c ON c.date = p.previous_date
      WHERE NOT EXISTS (SELECT 1 FROM comp q WHERE q.date = p.date AND q.coin_id = c.coin_id))"""


@query(
    "r04_member_changes",
    f"{SQL_INDEX}, {_CHANGES} SELECT date, change, coin_id, CAST(rank AS INTEGER) AS rank FROM ch",
)
def r04_member_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.membership_changes(events_result(spark, sf_dir).composition)


@query(
    "r04_member_summary",
    f"""{SQL_INDEX}, {_CHANGES}
    SELECT p.date, p.previous_date,
      CASE WHEN p.previous_date IS NULL THEN 'N/A (first day)' ELSE coalesce((
        SELECT string_agg(upper(coin_id), ', ' ORDER BY rank) FROM ch WHERE ch.date = p.date AND change = 'added'), 'None')
      END AS added,
      CASE WHEN p.previous_date IS NULL THEN 'N/A (first day)' ELSE coalesce((
        SELECT string_agg(upper(coin_id), ', ' ORDER BY rank) FROM ch WHERE ch.date = p.date AND change = 'removed'), 'None')
      END AS removed
    FROM p""",
)
def r04_member_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.membership_summary(events_result(spark, sf_dir).composition)


@query(
    "r05_day_totals",
    f"{SQL_INDEX} SELECT date, count(*) AS member_count, round(sum(volume), 4) AS listed_volume FROM comp GROUP BY date",
)
def r05_day_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rp.day_totals(events_result(spark, sf_dir).composition)
    return rows.withColumn("listed_volume", F.round("listed_volume", 4))


@query(
    "r06_grid",
    f"WITH {SQL_SHIPPING_INDEX} SELECT CAST(year(date) AS INTEGER) AS year, "
    + ", ".join(f"bool_or(month(date) = {m}) AS m{m:02d}" for m in range(1, 13))
    + " FROM comp GROUP BY year(date)",
)
def r06_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.availability_grid(shipping_result(spark, sf_dir).composition)


_SQL_MAGNITUDE = """CASE WHEN {v} >= 1e9 THEN printf('$%.2fB', {v} / 1e9) WHEN {v} >= 1e6 THEN printf('$%.2fM', {v} / 1e6)
    ELSE '$' || format('{{:,.0f}}', {v}) END"""


@query(
    "r07_status",
    f"""
    WITH cov AS (SELECT coin_id, min(date) AS start_date, max(date) AS end_date, count(*) AS days
                 FROM ({SQL_EV}) GROUP BY coin_id)
    SELECT c_custkey + 1 AS position, CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS symbol, c_name AS name,
      {_SQL_MAGNITUDE.format(v="(c_acctbal * 1000)")} AS market_cap_label, start_date, end_date, days
    FROM customer JOIN cov ON cov.coin_id = lower(CAST(c_custkey AS VARCHAR))""",
)
def r07_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 1).alias("position"),
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_mktsegment").alias("symbol"),
        F.col("c_name").alias("name"),
        (F.col("c_acctbal") * 1000).alias("market_cap"),
    )
    return rp.status_rows(listed, coverage(events_daily(spark, sf_dir)))


@query(
    "r08_counters",
    f"""
    WITH acc AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer), cov AS (SELECT DISTINCT coin_id FROM ({SQL_EV})),
    s AS (SELECT count(*) AS n FROM ({SQL_CLASSIFIED}) WHERE reason IS NOT NULL)
    SELECT count(*) + any_value(s.n) AS total, count(cov.coin_id) AS with_data, any_value(s.n) AS skipped, count(*) AS accepted
    FROM acc LEFT JOIN cov ON cov.coin_id = acc.id CROSS JOIN s""",
)
def r08_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    off = skipped(classified_parts(spark, sf_dir))
    return rp.report_counters(listed, off, coverage(events_daily(spark, sf_dir)))


_AMOUNT = "(p_retailprice * p_retailprice * p_size * 20)"


@query(
    "r09_format",
    f"SELECT p_partkey, {_SQL_MAGNITUDE.format(v=_AMOUNT)} AS label FROM part",
)
def r09_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        "p_partkey", magnitude_label(price * price * F.col("p_size") * 20).alias("label")
    )


@query(
    "r10_buckets",
    f"""SELECT id AS coin_id, reason, CASE WHEN contains(reason, 'BTC') OR contains(reason, 'Bitcoin') THEN 'btc'
      WHEN contains(reason, 'Stablecoin') THEN 'stablecoin'
      WHEN contains(lower(reason), 'historical') OR contains(reason, 'Insufficient') THEN 'history'
      ELSE 'wrapped' END AS bucket
    FROM (SELECT id, reason FROM ({SQL_CLASSIFIED}) WHERE reason IS NOT NULL
          UNION ALL SELECT id, 'Insufficient historical data (starts ' || name || ')' FROM ({SQL_PRT}))""",
)
def r10_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = skipped(classified_parts(spark, sf_dir)).select("coin_id", "reason")
    short = parts(spark, sf_dir).select(
        F.col("id").alias("coin_id"),
        F.concat(F.lit("Insufficient historical data (starts "), "name", F.lit(")")).alias("reason"),
    )
    return rp.skipped_buckets(off.unionByName(short))


@query(
    "r11_dataset_status",
    f"""{SQL_INDEX}
    SELECT (SELECT count(DISTINCT coin_id) FROM ({SQL_EVQ})) AS n_entities,
      (SELECT count(*) FROM (SELECT DISTINCT coin_id, quote FROM ({SQL_EVQ}))) AS n_pairs,
      count(*) AS index_days, min(date) AS first_date, max(date) AS last_date FROM idx""",
)
def r11_dataset_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = weighted_index(events_daily(spark, sf_dir), TOP_N, WINDOW)
    return rp.dataset_status(events_daily_by_type(spark, sf_dir), index)
