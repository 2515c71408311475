"""Incremental maintenance queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.registry import query
from catalogue.views import SQL_EVQ, events_daily, events_daily_by_type, sql_events, table
from tidemark.operators import maintain as mt

_OUT = "coin_id, quote, date, close, volume_to"
_COLUMNS = ["coin_id", "quote", "date", "close", "volume_to"]

# Leading zeros of varying length, zeros in the middle, and series without any positive close
_SQL_ZEROED = f"""SELECT coin_id, quote, date, volume_to,
    CASE WHEN day(date) <= CAST(coin_id AS BIGINT) % 11 OR day(date) = 20 OR coin_id LIKE '%3' THEN 0.0::DOUBLE
         ELSE close END AS close FROM ({SQL_EVQ})"""


def _zeroed(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.dayofmonth("date")
    zero = (day <= F.col("coin_id").cast("bigint") % 11) | (day == 20) | F.col("coin_id").like("%3")
    return events_daily_by_type(spark, sf_dir).withColumn("close", F.when(zero, 0.0).otherwise(F.col("close")))


@query(
    "i01_trim_leading",
    f"""
    WITH px AS ({_SQL_ZEROED}),
    f AS (SELECT coin_id, quote, min(date) FILTER (close > 0) AS first FROM px GROUP BY ALL)
    SELECT px.coin_id, px.quote, px.date, px.close, px.volume_to
    FROM px JOIN f ON f.coin_id = px.coin_id AND f.quote = px.quote
    WHERE f.first IS NULL OR px.date >= f.first
    """,
)
def i01_trim_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.trim_leading(_zeroed(spark, sf_dir)).select(*_COLUMNS)


@query(
    "i02_upsert_keep_last",
    f"""
    WITH u AS (SELECT *, 0 AS src FROM ({sql_events("event_type <> 'error'")})
               UNION ALL SELECT *, 1 AS src FROM ({sql_events("event_type = 'error'")}))
    SELECT coin_id, date, close, volume_to FROM u
    QUALIFY row_number() OVER (PARTITION BY coin_id, date ORDER BY src DESC) = 1
    """,
)
def i02_upsert_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = events_daily(spark, sf_dir, F.col("event_type") != "error")
    delta = events_daily(spark, sf_dir, F.col("event_type") == "error")
    return mt.upsert_keep_last(base, delta, ["coin_id", "date"]).select("coin_id", "date", "close", "volume_to")


@query(
    "i03_dedup_first",
    """
    SELECT CAST(user_id AS VARCHAR) AS coin_id, CAST(ts AS DATE) AS date, length(event_type) AS page, event_id AS pos, value
    FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY length(event_type), event_id) = 1
    """,
)
def i03_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("coin_id"),
        F.to_date("ts").alias("date"),
        F.length("event_type").cast("bigint").alias("page"),
        F.col("event_id").alias("pos"),
        "value",
    )
    return mt.dedup_pages(records, ["coin_id", "date"])


@query("i04_last_date", f"SELECT coin_id, quote, max(date) AS last_date FROM ({SQL_EVQ}) GROUP BY coin_id, quote")
def i04_last_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.last_dates(events_daily_by_type(spark, sf_dir))


_AS_OF = date(2024, 1, 29)


def _plan_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.nullif(F.lower("c_mktsegment"), F.lit("building")).alias("symbol"),
    )


def _sql_plan(cached: bool) -> str:
    seen = "l.last_date" if cached else "NULL"
    return f"""
    WITH ent AS (SELECT CAST(c_custkey AS VARCHAR) AS id, nullif(lower(c_mktsegment), 'building') AS symbol FROM customer),
    l AS (SELECT coin_id, quote, max(date) AS last_date FROM ({SQL_EVQ}) GROUP BY ALL),
    p AS (SELECT e.id AS coin_id, upper(coalesce(e.symbol, e.id)) AS symbol, q.quote, {seen} AS seen
          FROM ent e CROSS JOIN (VALUES ('CLICK'), ('VIEW'), ('BTC')) AS q(quote)
          LEFT JOIN l ON l.coin_id = e.id AND l.quote = q.quote)
    SELECT coin_id, symbol, quote,
      CASE WHEN seen IS NULL THEN DATE '2011-05-28'
           WHEN seen < DATE '2024-01-28' THEN CAST(seen + INTERVAL 1 DAY AS DATE) END AS start_date,
      DATE '2024-01-28' AS end_date,
      CASE WHEN seen IS NULL THEN 'full' WHEN seen >= DATE '2024-01-28' THEN 'current' ELSE 'incremental' END AS mode
    FROM p"""


@query("i05_fetch_plan", _sql_plan(True))
def i05_fetch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = mt.last_dates(events_daily_by_type(spark, sf_dir))
    return mt.fetch_plan(_plan_entities(spark, sf_dir), last, _AS_OF, ["click", "view", "btc"])


@query("i05_fetch_plan_full", _sql_plan(False).replace("NULL AS seen", "CAST(NULL AS DATE) AS seen"))
def i05_fetch_plan_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = mt.last_dates(events_daily_by_type(spark, sf_dir))
    return mt.fetch_plan(
        _plan_entities(spark, sf_dir), last, _AS_OF, ["click", "view", "btc"], incremental=False
    )


@query(
    "i06_merge_outcome",
    f"""
    WITH base AS (SELECT * FROM ({SQL_EVQ}) WHERE date <= DATE '2024-01-20'),
    fresh AS (SELECT * FROM ({SQL_EVQ}) WHERE date >= DATE '2024-01-15' AND quote IN ('CLICK', 'VIEW') AND close > 30)
    SELECT coin_id, quote, date, close, 'new' AS origin FROM fresh
    UNION ALL
    SELECT b.coin_id, b.quote, b.date, b.close, 'cached' FROM base b
    WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.coin_id = b.coin_id AND f.quote = b.quote AND f.date = b.date)
    """,
)
def i06_merge_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs without new rows keep what they had; pairs with new rows are overlaid."""
    prices = events_daily_by_type(spark, sf_dir).select("coin_id", "quote", "date", "close")
    base = prices.filter(F.col("date") <= "2024-01-20").withColumn("origin", F.lit("cached"))
    fetched = F.col("quote").isin("CLICK", "VIEW") & (F.col("close") > 30)
    fresh = prices.filter((F.col("date") >= "2024-01-15") & fetched).withColumn("origin", F.lit("new"))
    return mt.upsert_keep_last(base, fresh)


@query("i07_single_quote", f"SELECT {_OUT} FROM ({SQL_EVQ}) WHERE quote = 'VIEW'")
def i07_single_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.single_quote(events_daily_by_type(spark, sf_dir), "view").select(*_COLUMNS)


@query(
    "i01_i02_refresh",
    f"""
    WITH z AS ({_SQL_ZEROED}),
    base AS (SELECT * FROM z WHERE date <= DATE '2024-01-20'),
    delta AS (SELECT coin_id, quote, date, volume_to, close + 1 AS close FROM ({SQL_EVQ}) WHERE date > DATE '2024-01-10'),
    m AS (SELECT coin_id, quote, date, close, volume_to FROM delta UNION ALL
          SELECT coin_id, quote, date, close, volume_to FROM base b WHERE NOT EXISTS (
            SELECT 1 FROM delta d WHERE d.coin_id = b.coin_id AND d.quote = b.quote AND d.date = b.date)),
    f AS (SELECT coin_id, quote, min(date) FILTER (close > 0) AS first FROM m GROUP BY ALL)
    SELECT m.coin_id, m.quote, m.date, m.close, m.volume_to
    FROM m JOIN f ON f.coin_id = m.coin_id AND f.quote = m.quote
    WHERE f.first IS NULL OR m.date >= f.first
    """,
)
def i01_i02_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert and trim at once, as in a bulk merge."""
    base = _zeroed(spark, sf_dir).filter(F.col("date") <= "2024-01-20").select(*_COLUMNS)
    newer = events_daily_by_type(spark, sf_dir).filter(F.col("date") > "2024-01-10")
    delta = newer.withColumn("close", F.col("close") + 1).select(*_COLUMNS)
    return mt.refresh(base, delta)
