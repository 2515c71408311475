"""Trend, backfill and relative performance queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.cycles import SQL_SHIPPING_INDEX, TOP_N, WINDOW, shipping_index, sql_normalised, sql_slice
from catalogue.registry import query
from catalogue.views import CYCLES, SQL_EV, SQL_LIN, events_daily, shipping_daily, sql_members
from tidemark.operators import trend as tr
from tidemark.operators.index import weighted_index
from tidemark.session import materialise

START, MIN_POINTS = date(1999, 1, 1), 30
_EV_START, _EV_POINTS = date(2024, 1, 2), 20


def _sql_trend(series: str, start: date, points: int) -> str:
    return f"""
    SELECT coin_id, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, regr_r2(y, x) AS r2, count(*) AS n_points
    FROM (SELECT coin_id, date, datediff('day', DATE '{start}', date)::DOUBLE AS x,
            close / first_value(close) OVER (PARTITION BY coin_id ORDER BY date) AS y
          FROM ({series}))
    WHERE date >= DATE '{start}'
    GROUP BY coin_id HAVING count(*) >= {points}"""


_TREND_COLUMNS = "coin_id, round(a, 8) AS a, round(b, 6) AS b, round(r2, 6) AS r2, n_points"


def _tidy(trend: DataFrame) -> DataFrame:
    return trend.select(
        "coin_id",
        F.round("a", 8).alias("a"),
        F.round("b", 6).alias("b"),
        F.round("r2", 6).alias("r2"),
        "n_points",
    )


def _events_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.linear_trend(events_daily(spark, sf_dir), _EV_START, min_points=_EV_POINTS)


@query("p01_trend", f"SELECT {_TREND_COLUMNS} FROM ({_sql_trend(SQL_EV, _EV_START, _EV_POINTS)})")
def p01_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(_events_trend(spark, sf_dir))


@query("p02_rising", f"SELECT {_TREND_COLUMNS} FROM ({_sql_trend(SQL_EV, _EV_START, _EV_POINTS)}) WHERE a > 0")
def p02_rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(tr.rising(_events_trend(spark, sf_dir)))


@query(
    "p03_top10",
    f"SELECT {_TREND_COLUMNS} FROM ({_sql_trend(SQL_EV, _EV_START, _EV_POINTS)}) t ORDER BY t.a DESC, coin_id LIMIT 10",
)
def p03_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(tr.top_performers(_events_trend(spark, sf_dir)))


_LAST = CYCLES[-1].number


@query(
    "p03_top_series",
    f"""
    WITH best AS (SELECT * FROM ({_sql_trend(SQL_LIN, START, MIN_POINTS)}) ORDER BY a DESC, coin_id LIMIT 2),
    s AS ({sql_slice(SQL_LIN, "x.coin_id, x.date, x.close")} WHERE c.cycle = {_LAST})
    SELECT n.coin_id, round(b.a, 10) AS a, n.cycle, n.days_from_anchor, n.date, n.close, round(n.normalised, 8) AS normalised
    FROM ({sql_normalised("SELECT * FROM s", "coin_id, cycle", "close")}) n JOIN best b USING (coin_id)""",
)
def p03_top_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = shipping_daily(spark, sf_dir)
    rows = tr.top_performer_series(prices, tr.linear_trend(prices, START), CYCLES, k=2)
    return rows.withColumn("a", F.round("a", 10)).withColumn("normalised", F.round("normalised", 8))


# Series that begin on different dates, so that the later ones are extended backwards
_SQL_LATE = f"SELECT * FROM ({SQL_LIN}) WHERE date >= DATE '1998-01-01' + CAST(ascii(coin_id) * 7 AS INTEGER)"
_CUTOFF = date(1999, 11, 20)
# Only priced members: the first index value is then positive and every series can start at 1.0.
_SQL_STRICT = sql_members(SQL_LIN, WINDOW, TOP_N, strict=True)


def _stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index, as a backfill looks it up several times."""
    prices = shipping_daily(spark, sf_dir)
    return materialise(weighted_index(prices, TOP_N, WINDOW, price_mask="strict"), "index")


_SQL_BACKFILL = f"""
    own AS ({_SQL_LATE}),
    f AS (SELECT coin_id, min(date) AS first_date, arg_min(close, date) AS first_price FROM own GROUP BY coin_id
          HAVING min(date) < DATE '{_CUTOFF}'),
    k AS (SELECT f.coin_id, f.first_date, f.first_price / nullif(i.index_price, 0) AS k
          FROM f JOIN idx i ON i.date = f.first_date),
    filled AS (
      SELECT o.coin_id, o.date, o.close AS price, FALSE AS is_backfilled FROM own o WHERE o.coin_id IN (SELECT coin_id FROM f)
      UNION ALL
      SELECT k.coin_id, i.date, i.index_price * k.k, TRUE FROM k JOIN idx i ON i.date < k.first_date
      WHERE k.k IS NOT NULL)"""


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin = F.date_add(F.lit(date(1998, 1, 1)), F.ascii("coin_id") * 7)
    return shipping_daily(spark, sf_dir).filter(F.col("date") >= begin)


@query(
    "p04_backfill",
    f"WITH {_SQL_STRICT}, {_SQL_BACKFILL} SELECT coin_id, date, "
    "CASE WHEN is_backfilled THEN round(price, 4) ELSE price END AS price, is_backfilled FROM filled",
)
def p04_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tr.backfill(_late(spark, sf_dir), _stored_index(spark, sf_dir), _CUTOFF)
    shown = F.when(F.col("is_backfilled"), F.round("price", 4)).otherwise(F.col("price"))
    return rows.withColumn("price", shown)


@query(
    "p05_start_norm",
    f"""WITH {_SQL_STRICT}, {_SQL_BACKFILL},
    s AS (SELECT *, first_value(price) OVER (PARTITION BY coin_id ORDER BY date) AS base FROM filled)
    SELECT coin_id, date, is_backfilled, round(price / base, 7) AS normalised FROM s WHERE base > 0""",
)
def p05_start_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tr.start_at_one(tr.backfill(_late(spark, sf_dir), _stored_index(spark, sf_dir), _CUTOFF))
    return rows.select("coin_id", "date", "is_backfilled", F.round("normalised", 7).alias("normalised"))


@query(
    "p06_half_month",
    f"""
    SELECT coin_id, CASE WHEN day(date) < 15 THEN date_trunc('month', date)::DATE
                         ELSE (date_trunc('month', date) + INTERVAL 14 DAY)::DATE END AS period,
      arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close,
      sum(volume_to) AS volume, count(*) AS days
    FROM ({SQL_EV}) GROUP BY ALL""",
)
def p06_half_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.half_month_bars(events_daily(spark, sf_dir))


@query(
    "p07_fit",
    f"""
    WITH t AS ({_sql_trend(SQL_LIN, START, MIN_POINTS)}),
    y AS (SELECT * FROM (SELECT coin_id, date, datediff('day', DATE '{START}', date)::DOUBLE AS x,
            close / first_value(close) OVER (PARTITION BY coin_id ORDER BY date) AS y
          FROM ({SQL_LIN})) WHERE date >= DATE '{START}')
    {sql_slice("SELECT y.coin_id, y.date, y.y, t.a * y.x + t.b AS fitted FROM y JOIN t USING (coin_id)",
               "x.coin_id, x.date, round(x.y, 7) AS y, round(x.fitted, 7) AS fitted")} WHERE c.cycle = {_LAST}""",
)
def p07_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tr.fitted_line(shipping_daily(spark, sf_dir), CYCLES, START)
    return rows.withColumn("y", F.round("y", 7)).withColumn("fitted", F.round("fitted", 7))


_SQL_MARKET = sql_normalised(sql_slice("SELECT * FROM idx", "x.date, x.index_price"), "cycle", "index_price")


@query(
    "p08_relative",
    f"""WITH {SQL_SHIPPING_INDEX}
    SELECT o.coin_id, o.cycle, o.days_from_anchor, o.date, round(o.normalised, 7) AS normalised,
      round(m.normalised, 7) AS index_normalised, round(o.normalised / nullif(m.normalised, 0), 7) AS relative
    FROM ({sql_normalised(sql_slice(SQL_LIN, "x.coin_id, x.date, x.close"), "coin_id, cycle", "close")}) o
    JOIN ({_SQL_MARKET}) m USING (cycle, days_from_anchor)""",
)
def p08_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tr.relative_performance(shipping_daily(spark, sf_dir), shipping_index(spark, sf_dir), CYCLES)
    for name in ("normalised", "index_normalised", "relative"):
        rows = rows.withColumn(name, F.round(name, 7))
    return rows
