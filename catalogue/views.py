"""Daily series and entity lists derived from the supplied tables, in Spark and in SQL.

Money is summed in whole cents: the sums are exact, so ranks and ties do not depend on the order in
which rows are added up.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.cycles import cycle_windows
from tidemark.params import RuleSet

# Anchors inside the range of the order and shipping dates; their windows overlap
ANCHORS = (date(1996, 6, 1), date(1998, 1, 15), date(2000, 3, 1))
CYCLES = cycle_windows(ANCHORS)

PART_RULES = RuleSet(
    allowed=("red-ring", "brand#7"),
    stable_ids=("blue-bolt", "hot-gear", "red-ring"),
    stable_symbols=("brand#2", "brand#3"),
    wrapped_ids=("old-bolt", "cold-ring"),
    wrapped_patterns=("^small-", "promo$", "-gizmo ", "^w[a-z]{2,6}$"),
    base_ids=("red-bolt",),
    base_pattern="widget|gear",
    derivative_pattern="economy|large",
    derivative_symbols=("brand#11",),
)


def _cents(amount: str) -> Column:
    return F.rint(F.col(amount) * 100).cast("bigint")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _daily(rows: DataFrame, keys: list, amount: str, order: str) -> DataFrame:
    """Daily bars of single observations; partial sums are made before the shuffle."""
    cents = F.sum(_cents(amount))
    return rows.groupBy(*keys).agg(
        F.min_by(amount, order).alias("open"),
        F.max(amount).alias("high"),
        F.min(amount).alias("low"),
        (cents / F.count(F.lit(1)) / F.lit(100.0)).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume_from"),
        cents.cast("double").alias("volume_to"),
    )


def _user(column: str = "user_id") -> Column:
    return F.col(column).cast("string").alias("coin_id")


def events_daily(spark: SparkSession, sf_dir: str, keep: Column | None = None) -> DataFrame:
    """One series per user."""
    rows = table(spark, sf_dir, "events")
    if keep is not None:
        rows = rows.filter(keep)
    return _daily(rows, [_user(), F.to_date("ts").alias("date")], "value", "event_id")


def events_daily_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per user and event type; the type plays the quote."""
    rows = table(spark, sf_dir, "events")
    keys = [_user(), F.upper("event_type").alias("quote"), F.to_date("ts").alias("date")]
    return _daily(rows, keys, "value", "event_id").select(
        "coin_id", "quote", "date", "open", "high", "low", "close", "volume_from", "volume_to"
    )


def shipping_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per return flag and line status, over several years."""
    coin = F.lower(F.concat("l_returnflag", "l_linestatus")).alias("coin_id")
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(coin, F.to_date("l_shipdate").alias("date")).agg(
        (F.sum(_cents("l_extendedprice")) / F.count(F.lit(1)) / F.lit(100.0)).alias("close"),
        F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("volume_to"),
    )


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One single series."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date"))
        .agg(
            (F.sum(_cents("o_totalprice")) / F.count(F.lit(1)) / F.lit(100.0)).alias("close"),
            F.sum(_cents("o_totalprice")).cast("double").alias("volume"),
        )
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity list."""
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.regexp_replace(F.lower("p_name"), " ", "-").alias("id"),
        F.col("p_brand").alias("symbol"),
        F.col("p_type").alias("name"),
        F.col("p_retailprice").alias("market_cap"),
    )


# ---------------------------------------------------------------------------
# The same in SQL
# ---------------------------------------------------------------------------


def _sql_daily(keys: str, amount: str, order: str, source: str) -> str:
    return f"""
    SELECT {keys}, arg_min({amount}, {order}) AS open, max({amount}) AS high, min({amount}) AS low,
           CAST(sum(CAST(round({amount} * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0::DOUBLE AS close,
           CAST(count(*) AS DOUBLE) AS volume_from,
           CAST(sum(CAST(round({amount} * 100) AS BIGINT)) AS DOUBLE) AS volume_to
    FROM {source} GROUP BY ALL"""


def sql_events(where: str = "TRUE") -> str:
    keys = "CAST(user_id AS VARCHAR) AS coin_id, CAST(ts AS DATE) AS date"
    return _sql_daily(keys, "value", "event_id", f"(SELECT * FROM events WHERE {where})")


SQL_EV = sql_events()
SQL_EVQ = _sql_daily(
    "CAST(user_id AS VARCHAR) AS coin_id, upper(event_type) AS quote, CAST(ts AS DATE) AS date",
    "value",
    "event_id",
    "events",
)
SQL_LIN = """
    SELECT lower(l_returnflag || l_linestatus) AS coin_id, CAST(l_shipdate AS DATE) AS date,
           CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0::DOUBLE AS close,
           CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS volume_to
    FROM lineitem GROUP BY ALL"""
SQL_ORD = """
    SELECT CAST(o_orderdate AS DATE) AS date,
           CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0::DOUBLE AS close,
           CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS volume
    FROM orders GROUP BY ALL"""
SQL_PRT = """
    SELECT p_partkey, replace(lower(p_name), ' ', '-') AS id, p_brand AS symbol, p_type AS name,
           p_retailprice AS market_cap
    FROM part"""
SQL_CYCLES = "SELECT * FROM (VALUES " + ", ".join(
    f"({c.number}, DATE '{c.start}', DATE '{c.anchor}', DATE '{c.end}')" for c in CYCLES
) + ") AS v(cycle, s, a, e)"


def sql_members(series: str, window: int, top_n: int, strict: bool = False) -> str:
    """CTEs ``px, grid, smooth, members, idx, comp`` of the index, on a dense calendar with ROWS frames."""
    mask = "AND price IS NOT NULL" if strict else ""
    return f"""
    px AS ({series}),
    grid AS (
      SELECT c.coin_id, CAST(d.day AS DATE) AS date
      FROM (SELECT DISTINCT coin_id FROM px) c
      CROSS JOIN (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS day FROM px) d),
    dense AS (SELECT g.coin_id, g.date, p.close, p.volume_to FROM grid g LEFT JOIN px p USING (coin_id, date)),
    smooth AS (
      SELECT coin_id, date,
        CASE WHEN count(volume_to) OVER w = {window} THEN avg(volume_to) OVER w END AS sma,
        CASE WHEN date > min(CASE WHEN volume_to IS NOT NULL THEN date END) OVER (PARTITION BY coin_id)
                         + {window - 1} THEN close END AS price
      FROM dense
      WINDOW w AS (PARTITION BY coin_id ORDER BY date ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)),
    members AS (
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY date ORDER BY sma DESC, coin_id) AS rank
        FROM smooth WHERE sma IS NOT NULL {mask}) WHERE rank <= {top_n}),
    idx AS (
      SELECT * FROM (
        SELECT date, coalesce(sum(price * sma), 0) / nullif(sum(sma), 0) AS index_price,
               sum(sma) AS total_volume, count(*) AS coin_count
        FROM members GROUP BY date) WHERE index_price IS NOT NULL AND coin_count >= 3),
    comp AS (
      SELECT m.date, m.rank, m.coin_id, m.sma AS volume, m.sma / t.total AS weight, m.price
      FROM members m JOIN (SELECT date, sum(sma) AS total FROM members GROUP BY date) t USING (date)
      WHERE m.price IS NOT NULL AND t.total > 0 AND m.date IN (SELECT date FROM idx))"""
