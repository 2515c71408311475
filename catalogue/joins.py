"""As-of joins, interval joins and running numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.cycles import urgent_orders
from catalogue.registry import query
from catalogue.views import CYCLES, SQL_CYCLES, SQL_LIN, shipping_daily, table
from tidemark.operators.asof import asof_join
from tidemark.operators.intervals import interval_join
from tidemark.operators.numbering import running

#: So small that most groups of the supplied tables are cut.
_CUT = 50


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")


def _purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest purchase of each user and time."""
    rows = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    return rows.groupBy("user_id", "ts").agg(F.max("value").alias("value"))


_SQL_PURCHASES = "SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL"


def _sql_asof(comparison: str, kind: str = "LEFT") -> str:
    return f"""SELECT e.event_id, e.user_id, e.ts, e.value, p.ts AS ts_right, p.value AS value_right
    FROM events e ASOF {kind} JOIN ({_SQL_PURCHASES}) p ON e.user_id = p.user_id AND e.ts {comparison} p.ts"""


@query("c07_asof_backward", _sql_asof(">="))
def c07_asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the last purchase of its user up to it; large groups are cut."""
    return asof_join(_events(spark, sf_dir), _purchases(spark, sf_dir), "ts", ["user_id"], group_rows=_CUT)


@query("c07_asof_backward_strict", _sql_asof(">", ""))
def c07_asof_backward_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof_join(_events(spark, sf_dir), _purchases(spark, sf_dir), "ts", ["user_id"], strict=True, how="inner")


@query("c07_asof_forward", _sql_asof("<="))
def c07_asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof_join(_events(spark, sf_dir), _purchases(spark, sf_dir), "ts", ["user_id"], "forward", group_rows=_CUT)


_SQL_URGENT_DAYS = """SELECT CAST(o_orderdate AS DATE) AS date,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0::DOUBLE AS rate
    FROM orders WHERE o_orderpriority = '1-URGENT' AND day(o_orderdate) % 3 = 0 GROUP BY ALL"""


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base series that lacks most days."""
    return urgent_orders(spark, sf_dir).filter(F.dayofmonth("date") % 3 == 0).select("date", F.col("close").alias("rate"))


@query(
    "c07_convert_asof",
    f"""SELECT coin_id, date, close, CASE WHEN date - d <= 2 THEN d END AS date_right, CASE WHEN date - d <= 2 THEN rate END AS rate
    FROM (SELECT x.coin_id, x.date, x.close, r.date AS d, r.rate
      FROM ({SQL_LIN}) x ASOF LEFT JOIN ({_SQL_URGENT_DAYS}) r ON x.date >= r.date)""",
)
def c07_convert_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices with the last known rate of the base series, of at most two days before. All rows are of one group, which is cut."""
    prices = shipping_daily(spark, sf_dir).select("coin_id", "date", "close")
    return asof_join(prices, _rates(spark, sf_dir), "date", tolerance=2, group_rows=500)


@query(
    "c07_asof_nearest",
    f"""WITH r AS ({_SQL_URGENT_DAYS}),
    b AS (SELECT x.coin_id, x.date, r.date AS before FROM ({SQL_LIN}) x ASOF LEFT JOIN r ON x.date >= r.date),
    f AS (SELECT b.coin_id, b.date, b.before, r.date AS after FROM b ASOF LEFT JOIN r ON b.date <= r.date)
    SELECT f.coin_id, f.date, r.date AS date_right, r.rate
    FROM f LEFT JOIN r ON r.date = CASE WHEN before IS NULL OR after - f.date < f.date - before THEN after ELSE before END""",
)
def c07_asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = shipping_daily(spark, sf_dir).select("coin_id", "date")
    return asof_join(prices, _rates(spark, sf_dir), "date", direction="nearest", group_rows=500)


@query(
    "c04_asof_anchor",
    f"""SELECT k.coin_id, c.cycle, c.a AS anchor_date, x.date, x.close
    FROM (SELECT DISTINCT coin_id FROM ({SQL_LIN})) k CROSS JOIN ({SQL_CYCLES}) c
    ASOF LEFT JOIN ({SQL_LIN}) x ON x.coin_id = k.coin_id AND c.a <= x.date""",
)
def c04_asof_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first day of each series at or after each anchor."""
    prices = shipping_daily(spark, sf_dir).select("coin_id", "date", "close")
    cycles = F.explode(F.array(*[F.struct(F.lit(c.number).alias("cycle"), F.lit(c.anchor).alias("anchor_date")) for c in CYCLES]))
    anchors = prices.select("coin_id").distinct().select("coin_id", cycles.alias("c")).select("coin_id", "c.*")
    return asof_join(anchors, prices, "anchor_date", ["coin_id"], "forward", right_on="date")


_SQL_SPANS = """SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS s,
    CAST(l_shipdate AS DATE) + CAST((l_orderkey * 7 + l_linenumber) % 40 + CASE WHEN l_orderkey % 1000 = 1 THEN 1500 ELSE 0 END AS INTEGER) AS e
    FROM lineitem"""


@query(
    "c02_interval_join",
    f"""SELECT i.l_orderkey, i.l_linenumber, count(*) AS orders, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents
    FROM ({_SQL_SPANS}) i JOIN orders o ON CAST(o.o_orderdate AS DATE) BETWEEN i.s AND i.e GROUP BY ALL""",
)
def c02_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders within an interval for every line item, a few of which span years."""
    days = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 40 + F.when(F.col("l_orderkey") % 1000 == 1, 1500).otherwise(0)).cast("int")
    start = F.to_date("l_shipdate")
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", start.alias("s"), F.date_add(start, days).alias("e"))
    orders = table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("day"), F.rint(F.col("o_totalprice") * 100).cast("bigint").alias("cents")
    )
    # Orders of a day are added up before they meet intervals.
    daily = orders.groupBy("day").agg(F.count("*").alias("orders"), F.sum("cents").alias("cents"))
    met = interval_join(daily, spans, "day", "s", "e")
    return met.groupBy("l_orderkey", "l_linenumber").agg(F.sum("orders").alias("orders"), F.sum("cents").alias("cents"))


@query(
    "c02_interval_by_user",
    """WITH i AS (SELECT event_id AS span_id, user_id, ts AS s, ts + to_microseconds(CAST(event_id % 50 AS BIGINT) * 3600000000) AS e FROM events)
    SELECT i.span_id, e.event_id, e.user_id FROM i JOIN events e ON e.user_id = i.user_id AND e.ts > i.s AND e.ts <= i.e""",
)
def c02_interval_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an event and a later one of the same user, up to two days later; the interval starts behind its first end."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    hours = F.make_dt_interval(hours=(F.col("event_id") % 50).cast("int"))
    spans = events.select(F.col("event_id").alias("span_id"), "user_id", F.col("ts").alias("s"), (F.col("ts") + hours).alias("e"))
    return interval_join(events, spans, "ts", "s", "e", ["user_id"], closed="right").select("span_id", "event_id", "user_id")


@query(
    "r03_running_number",
    """SELECT event_id, row_number() OVER w AS number, coalesce(lag(user_id) OVER w, -1) AS previous_user, lead(ts) OVER w AS next_ts,
      sum(CAST(round(value * 100) AS BIGINT)) OVER (ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cents_so_far
    FROM events WINDOW w AS (ORDER BY ts DESC, event_id)""",
)
def r03_running_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, newest first: number, total so far, neighbours."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.rint(F.col("value") * 100).cast("bigint").alias("cents"))
    numbered = running(
        rows,
        [F.desc("ts"), F.asc("event_id")],
        totals={"cents_so_far": "cents"},
        previous={"previous_user": "user_id"},
        following={"next_ts": "ts"},
        partitions=16,
    )
    before = F.coalesce("previous_user", F.lit(-1)).alias("previous_user")
    return numbered.select("event_id", "number", before, "next_ts", "cents_so_far")


@query(
    "s08_ranked_after_cut",
    """SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS position FROM part
    WHERE p_brand <> 'Brand#13' QUALIFY position BETWEEN 101 AND 1000""",
)
def s08_ranked_after_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions 101 to 1000 of a ranking of any length."""
    rows = table(spark, sf_dir, "part").filter(F.col("p_brand") != "Brand#13").select("p_partkey", "p_retailprice")
    ranked = running(rows, [F.desc("p_retailprice"), F.asc("p_partkey")], number="position", partitions=8)
    return ranked.filter(F.col("position").between(101, 1000)).select("p_partkey", "position")
