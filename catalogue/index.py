"""Rolling and index queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.registry import query
from catalogue.views import SQL_EV, SQL_EVQ, SQL_LIN, events_daily, events_daily_by_type, shipping_daily, sql_members
from tidemark.operators import index as ix
from tidemark.operators import rolling, wide
from tidemark.operators.maintain import single_quote

WINDOW, TOP_N = 7, 10
DAY, START, END = date(2024, 1, 20), date(2024, 1, 15), date(2024, 1, 25)
ENTITY = "3"

SQL_INDEX = "WITH " + sql_members(SQL_EV, WINDOW, TOP_N)
SQL_INDEX_STRICT = "WITH " + sql_members(SQL_EV, WINDOW, TOP_N, strict=True)
_INDEX_COLUMNS = "date, round(index_price, 6) AS index_price, round(total_volume, 4) AS total_volume, coin_count"
_COMP_COLUMNS = (
    "date, CAST(rank AS INTEGER) AS rank, coin_id, round(volume, 4) AS volume, round(weight, 9) AS weight, price"
)


def tidy_index(rows: DataFrame) -> DataFrame:
    return rows.select(
        "date",
        F.round("index_price", 6).alias("index_price"),
        F.round("total_volume", 4).alias("total_volume"),
        "coin_count",
    )


def tidy_composition(rows: DataFrame) -> DataFrame:
    return rows.select(
        "date",
        "rank",
        "coin_id",
        F.round("volume", 4).alias("volume"),
        F.round("weight", 9).alias("weight"),
        "price",
    )


@query(
    "t01_wide_frame",
    f"PIVOT (SELECT coin_id, date, close FROM ({SQL_LIN})) ON coin_id USING max(close) GROUP BY date",
)
def t01_wide_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column for each entity; all of them fit one block."""
    prices = shipping_daily(spark, sf_dir)
    (block,) = wide.blocks(prices)
    return wide.wide_block(prices, block)


@query("t01_wide_and_back", f"SELECT coin_id, date, close FROM ({SQL_EV}) WHERE close IS NOT NULL")
def t01_wide_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities in blocks of columns, and back."""
    prices = events_daily(spark, sf_dir).select("coin_id", "date", "close")
    return wide.long_all(*wide.wide_all(prices))


@query(
    "t01_calendar_align",
    f"""
    WITH px AS ({SQL_EV}),
    cal AS (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS day FROM px),
    ids AS (SELECT DISTINCT coin_id FROM px)
    SELECT i.coin_id, CAST(c.day AS DATE) AS date, p.close, p.volume_to
    FROM ids i CROSS JOIN cal c LEFT JOIN px p ON p.coin_id = i.coin_id AND p.date = CAST(c.day AS DATE)
    """,
)
def t01_calendar_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.align_calendar(events_daily(spark, sf_dir))


@query("t02_date_range", f"SELECT min(date) AS min_date, max(date) AS max_date FROM ({SQL_EV})")
def t02_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.date_range(events_daily(spark, sf_dir))


@query(
    "t03_rolling_volume",
    f"""
    WITH {sql_members(SQL_EV, WINDOW, TOP_N)}
    SELECT s.coin_id, s.date, round(s.sma, 6) AS volume_sma
    FROM smooth s JOIN px USING (coin_id, date)
    """,
)
def t03_rolling_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rolling.rolling_volume(events_daily(spark, sf_dir), WINDOW)
    return rows.select("coin_id", "date", F.round("volume_sma", 6).alias("volume_sma"))


@query(
    "t04_price_mask",
    f"""
    WITH {sql_members(SQL_EV, WINDOW, TOP_N)}
    SELECT s.coin_id, s.date, s.price FROM smooth s JOIN px USING (coin_id, date)
    """,
)
def t04_price_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.smooth_and_mask(events_daily(spark, sf_dir), WINDOW).select("coin_id", "date", "price")


@query(
    "t05_daily_topn",
    f"""{SQL_INDEX}
    SELECT date, CAST(rank AS INTEGER) AS rank, coin_id, round(sma, 4) AS volume, price FROM members""",
)
def t05_daily_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ix.ranked_members(events_daily(spark, sf_dir), TOP_N, WINDOW)
    return rows.select("date", "rank", "coin_id", F.round("volume", 4).alias("volume"), "price")


@query("t07_weighted_index", f"{SQL_INDEX} SELECT {_INDEX_COLUMNS} FROM idx")
def t07_weighted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy_index(ix.weighted_index(events_daily(spark, sf_dir), TOP_N, WINDOW))


@query("t07_weighted_index_strict", f"{SQL_INDEX_STRICT} SELECT {_INDEX_COLUMNS} FROM idx")
def t07_weighted_index_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy_index(ix.weighted_index(events_daily(spark, sf_dir), TOP_N, WINDOW, price_mask="strict"))


@query(
    "t07_weighted_index_long",
    f"WITH {sql_members(SQL_LIN, 60, 4)} SELECT {_INDEX_COLUMNS} FROM idx",
)
def t07_weighted_index_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few entities over many years, with the default window."""
    return tidy_index(ix.weighted_index(shipping_daily(spark, sf_dir), 4, 60))


@query(
    "t08_totals",
    f"{SQL_INDEX} SELECT date, round(total_volume, 4) AS total_volume, coin_count FROM idx",
)
def t08_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ix.weighted_index(events_daily(spark, sf_dir), TOP_N, WINDOW)
    return rows.select("date", F.round("total_volume", 4).alias("total_volume"), "coin_count")


@query(
    "t09_validity",
    f"""WITH {sql_members(SQL_LIN, 3, 2)}
    SELECT date, round(coalesce(sum(price * sma), 0) / nullif(sum(sma), 0), 6) AS index_price, count(*) AS coin_count
    FROM members GROUP BY date HAVING sum(sma) <> 0 AND count(*) >= 2""",
)
def t09_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ix.weighted_index(shipping_daily(spark, sf_dir), 2, 3, min_members=2)
    return rows.select("date", F.round("index_price", 6).alias("index_price"), "coin_count")


@query("t10_composition", f"{SQL_INDEX} SELECT {_COMP_COLUMNS} FROM comp")
def t10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy_composition(ix.composition(events_daily(spark, sf_dir), TOP_N, WINDOW))


_SINGLE_DAY = f"""
    WITH px AS ({SQL_EV}),
    day AS (SELECT * FROM px WHERE date = DATE '{DAY}' AND close > 0 AND volume_to > 0),
    top AS (
      SELECT *, row_number() OVER (ORDER BY volume_to DESC, coin_id) AS rank FROM day
      WHERE (SELECT count(*) FROM day) >= 3 QUALIFY rank <= {TOP_N})"""


@query(
    "t11_single_day_index",
    f"""{_SINGLE_DAY}
    SELECT date, round(sum(close * volume_to) / sum(volume_to), 6) AS index_price,
           round(sum(volume_to), 4) AS total_volume, count(*) AS coin_count FROM top GROUP BY date""",
)
def t11_single_day_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy_index(ix.single_day_index(events_daily(spark, sf_dir), DAY, TOP_N))


@query(
    "t11_single_day_composition",
    f"""{_SINGLE_DAY}
    SELECT date, CAST(rank AS INTEGER) AS rank, coin_id, round(volume_to, 4) AS volume,
           round(volume_to / sum(volume_to) OVER (), 9) AS weight, close AS price FROM top""",
)
def t11_single_day_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy_composition(ix.single_day_members(events_daily(spark, sf_dir), DAY, TOP_N))


@query(
    "t12_stats",
    f"""{SQL_INDEX}
    SELECT min(date) AS first_date, max(date) AS last_date, count(*) AS n_days,
           round(avg(coin_count), 6) AS avg_coins,
           (SELECT count(DISTINCT coin_id) FROM px) AS coins_processed
    FROM idx""",
)
def t12_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = events_daily(spark, sf_dir)
    stats = ix.index_stats(ix.weighted_index(prices, TOP_N, WINDOW), prices)
    return stats.withColumn("avg_coins", F.round("avg_coins", 6))


@query("t13_latest", f"{SQL_INDEX} SELECT {_INDEX_COLUMNS} FROM idx ORDER BY date DESC LIMIT 5")
def t13_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy_index(ix.latest(ix.weighted_index(events_daily(spark, sf_dir), TOP_N, WINDOW), 5))


@query(
    "t14_parameters",
    f"""
    WITH {sql_members(f"SELECT * FROM ({SQL_EVQ}) WHERE quote = 'CLICK'", 2, 20)}
    SELECT {_INDEX_COLUMNS} FROM idx""",
)
def t14_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = single_quote(events_daily_by_type(spark, sf_dir), "click")
    return tidy_index(ix.weighted_index(prices, top_n=20, window=2))


@query(
    "t15_coverage",
    f"""SELECT coin_id, min(date) AS start_date, max(date) AS end_date, count(*) AS days
    FROM ({SQL_EV}) GROUP BY coin_id""",
)
def t15_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.coverage(events_daily(spark, sf_dir))


@query(
    "f14_range",
    f"""{SQL_INDEX}
    SELECT {_INDEX_COLUMNS} FROM idx WHERE date BETWEEN DATE '{START}' AND DATE '{END}'""",
)
def f14_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the last days are smoothed, yet the values equal those of the full run."""
    return tidy_index(ix.weighted_index(events_daily(spark, sf_dir), TOP_N, WINDOW, START, END))


@query("f15_at_date", f"{SQL_INDEX} SELECT {_COMP_COLUMNS} FROM comp WHERE date = DATE '{DAY}'")
def f15_at_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy_composition(ix.composition_at(ix.composition(events_daily(spark, sf_dir), TOP_N, WINDOW), DAY))


@query(
    "f16_entity_history",
    f"""WITH {sql_members(SQL_LIN, WINDOW, 4)}
    SELECT {_COMP_COLUMNS} FROM comp WHERE coin_id = 'no'""",
)
def f16_entity_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy_composition(ix.entity_history(ix.composition(shipping_daily(spark, sf_dir), 4, WINDOW), "no"))
