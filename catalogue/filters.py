"""Classification and filter queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.registry import query
from catalogue.views import PART_RULES, SQL_EV, SQL_EVQ, SQL_PRT, events_daily, events_daily_by_type, parts, table
from tidemark.operators import classify as cl
from tidemark.operators import rule_tables as rt
from tidemark.operators.maintain import single_quote

CUTOFF = date(2024, 1, 2)
_PAGE = "https://www.cryptocompare.com/coins"


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _sql_flags(source: str, name: str = "lower(name)", symbol: str = "lower(symbol)") -> str:
    r = PART_RULES
    text = f"lower(id) || ' ' || {name}"
    wrapped = " OR ".join(f"regexp_matches({text}, '{p}')" for p in r.wrapped_patterns)
    return f"""
    SELECT *, lower(id) IN ({_listed(r.allowed)}) OR {symbol} IN ({_listed(r.allowed)}) AS f_allowed,
      lower(id) IN ({_listed(r.stable_ids)}) OR {symbol} IN ({_listed(r.stable_symbols)}) AS f_stable,
      lower(id) IN ({_listed(r.wrapped_ids)}) OR {wrapped} AS f_wrapped,
      lower(id) IN ({_listed(r.base_ids)}) OR {symbol} IN ({_listed(r.base_ids)}) AS f_base,
      (regexp_matches({text} || ' ' || {symbol}, '{r.base_pattern}')
        AND regexp_matches({text} || ' ' || {symbol}, '{r.derivative_pattern}'))
        OR lower(id) IN ({_listed(r.derivative_symbols)}) OR {symbol} IN ({_listed(r.derivative_symbols)}) AS f_deriv
    FROM ({source})"""


_SKIP = """CASE WHEN f_allowed THEN NULL WHEN f_stable THEN 'Stablecoin'
    WHEN f_wrapped THEN 'Wrapped/Staked/Bridged token' WHEN f_deriv AND NOT f_base THEN 'BTC derivative' END"""
_EXCLUDE = f"CASE WHEN f_allowed THEN NULL WHEN f_base THEN 'Bitcoin (base currency)' ELSE {_SKIP} END"
SQL_CLASSIFIED = f"SELECT p_partkey, id, symbol, name, market_cap, {_SKIP} AS reason FROM ({_sql_flags(SQL_PRT)})"


def classified_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.classify(parts(spark, sf_dir), PART_RULES)


@query(
    "f01_rule_flags",
    f"""SELECT p_partkey, f_allowed AS allowed, f_stable AND NOT f_allowed AS stable,
      f_wrapped AND NOT f_allowed AS wrapped, f_deriv AND NOT f_base AND NOT f_allowed AS derivative
    FROM ({_sql_flags(SQL_PRT)})""",
)
def f01_rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.col(c) for c in ("id", "name", "symbol")]
    return parts(spark, sf_dir).select(
        "p_partkey",
        cl.is_allowed(F.col("id"), F.col("symbol"), PART_RULES).alias("allowed"),
        cl.is_stable(*fields, PART_RULES).alias("stable"),
        cl.is_wrapped(*fields, PART_RULES).alias("wrapped"),
        cl.is_base_derivative(*fields, PART_RULES).alias("derivative"),
    )


@query("f05_classify", SQL_CLASSIFIED)
def f05_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified_parts(spark, sf_dir)


@query(
    "f06_eligible",
    f"SELECT p_partkey, id, symbol, name, market_cap, {_EXCLUDE} AS reason FROM ({_sql_flags(SQL_PRT)})",
)
def f06_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.classify(parts(spark, sf_dir), PART_RULES, "index")


@query("f05_rule_table", SQL_CLASSIFIED)
def f05_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules as a table that is joined by keys."""
    return rt.classify_by_tables(parts(spark, sf_dir), rt.rule_table(spark, PART_RULES), reasons=PART_RULES)


# Rules made from the data itself: beginnings, ends and inner strings of "id name"
_SQL_MADE = """SELECT DISTINCT 'prefix' AS form, lower(p_brand) || '-' || p_size || ' ' AS value FROM part WHERE p_size > 45
    UNION SELECT 'contains', right(p_brand, 1) || '-' || p_size || ' ' || substr(p_name, 1, 3) FROM part WHERE p_partkey % 7 = 0
    UNION SELECT 'suffix', p_size || ' ' || p_name FROM part WHERE p_partkey % 11 = 0"""


@query(
    "f03_many_rules",
    f"""WITH t AS (SELECT p_partkey, lower(p_brand) || '-' || p_size AS id, p_name AS name,
      lower(p_brand) || '-' || p_size || ' ' || lower(p_name) AS text FROM part),
    r AS ({_SQL_MADE})
    SELECT p_partkey, id, name, CASE WHEN
      text IN (SELECT t.text FROM t JOIN r ON r.form = 'prefix' AND starts_with(t.text, lower(r.value)))
      OR text IN (SELECT t.text FROM t JOIN r ON r.form = 'suffix' AND ends_with(t.text, lower(r.value)))
      OR text IN (SELECT t.text FROM t JOIN r ON r.form = 'contains' AND contains(t.text, lower(r.value)))
      THEN 'Wrapped/Staked/Bridged token' END AS reason FROM t""",
)
def f03_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules whose number grows with the data."""
    part = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    code = F.concat_ws("-", F.lower("p_brand"), size)
    inner = F.concat(F.right("p_brand", F.lit(1)), F.lit("-"), size, F.lit(" "), F.substring("p_name", 1, 3))
    forms = (
        part.filter("p_size > 45").select(F.lit("prefix").alias("form"), F.concat(code, F.lit(" ")).alias("value")),
        part.filter("p_partkey % 7 = 0").select(F.lit("contains").alias("form"), inner.alias("value")),
        part.filter("p_partkey % 11 = 0").select(F.lit("suffix").alias("form"), F.concat_ws(" ", size, "p_name").alias("value")),
    )
    rules = forms[0].unionByName(forms[1]).unionByName(forms[2]).distinct()
    rules = rules.select(F.lit("wrapped").alias("kind"), F.lit("id_name").alias("field"), "form", "value")
    entities = part.select("p_partkey", code.alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("symbol"))
    return rt.classify_by_tables(entities, rules).drop("symbol")


@query(
    "f07_split_url",
    f"""SELECT id AS coin_id, name, symbol, reason, '{_PAGE}/' || upper(symbol) || '/overview' AS url
    FROM ({SQL_CLASSIFIED}) WHERE reason IS NOT NULL""",
)
def f07_split_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.skipped(classified_parts(spark, sf_dir))


@query(
    "f07_accepted",
    f"SELECT p_partkey, id, symbol, name, market_cap FROM ({SQL_CLASSIFIED}) WHERE reason IS NULL",
)
def f07_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.accepted(classified_parts(spark, sf_dir))


@query(
    "f08_index_entities",
    f"""SELECT p_partkey, id, symbol, name, market_cap FROM ({_sql_flags(SQL_PRT)})
    WHERE {_EXCLUDE} IS NULL""",
)
def f08_index_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.index_entities(parts(spark, sf_dir), PART_RULES)


@query(
    "f08_index_rows",
    f"""SELECT id AS coin_id, p_partkey, market_cap
    FROM ({_sql_flags(SQL_PRT, name="''", symbol="lower(id)")}) WHERE {_EXCLUDE} IS NULL""",
)
def f08_index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare ids: no name is known and the symbol is the id."""
    rows = parts(spark, sf_dir).select(F.col("id").alias("coin_id"), "p_partkey", "market_cap")
    return cl.index_rows(rows, PART_RULES)


_SQL_SERIES = """SELECT replace(lower(p_name), ' ', '-') AS id, CAST(l_shipdate AS DATE) AS date,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS volume_to
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"""


@query(
    "f08_index_prices",
    f"""SELECT id AS coin_id, date, volume_to
    FROM ({_sql_flags(_SQL_SERIES, name="''", symbol="lower(id)")}) WHERE {_EXCLUDE} IS NULL""",
)
def f08_index_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of many rows per entity; the rules run once per entity."""
    named = parts(spark, sf_dir).select(F.col("p_partkey").alias("l_partkey"), F.col("id").alias("coin_id"))
    series = (
        table(spark, sf_dir, "lineitem")
        .join(named, "l_partkey")
        .groupBy("coin_id", F.to_date("l_shipdate").alias("date"))
        .agg(F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("volume_to"))
    )
    return cl.index_prices(series, PART_RULES)


@query("f09_reasons", f"SELECT reason, count(*) AS n FROM ({SQL_CLASSIFIED}) WHERE reason IS NOT NULL GROUP BY reason")
def f09_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.reason_counts(cl.skipped(classified_parts(spark, sf_dir)))


@query(
    "f10_counters",
    f"""SELECT count(*) AS fetched, count(reason) AS filtered, count(*) - count(reason) AS accepted
    FROM ({SQL_CLASSIFIED})""",
)
def f10_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.run_counters(classified_parts(spark, sf_dir))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of which only some have prices."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD")).alias("symbol"),
        F.nullif(F.col("c_name"), F.lit("Customer#000000003")).alias("name"),
    )


_SQL_CUSTOMERS = """SELECT CAST(c_custkey AS VARCHAR) AS id, nullif(c_mktsegment, 'HOUSEHOLD') AS symbol,
    nullif(c_name, 'Customer#000000003') AS name FROM customer"""
_SQL_EARLY = f"SELECT coin_id FROM ({SQL_EV}) GROUP BY coin_id HAVING min(date) < DATE '{CUTOFF}'"


@query("f11_history", f"SELECT * FROM ({_SQL_CUSTOMERS}) WHERE id IN ({_SQL_EARLY})")
def f11_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.with_history_before(_customers(spark, sf_dir), events_daily(spark, sf_dir), CUTOFF)


@query("f12_recent", f"SELECT * FROM ({_SQL_CUSTOMERS}) WHERE id NOT IN ({_SQL_EARLY})")
def f12_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.without_history_before(_customers(spark, sf_dir), events_daily(spark, sf_dir), CUTOFF)


# Suppliers stand for entities that are on the list already.
_SQL_KNOWN = """SELECT CAST(s_suppkey AS VARCHAR) AS coin_id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS symbol,
    'Stablecoin' AS reason, '' AS url FROM supplier WHERE s_acctbal > 5000"""


@query(
    "f13_append",
    f"""
    WITH known AS ({_SQL_KNOWN}), recent AS (SELECT * FROM ({_SQL_CUSTOMERS}) WHERE id NOT IN ({_SQL_EARLY})),
    firsts AS (SELECT coin_id, min(date) AS start_date FROM ({SQL_EV}) GROUP BY coin_id)
    SELECT coin_id, name, symbol, reason, url FROM known
    UNION ALL
    SELECT r.id, coalesce(r.name, r.symbol, upper(r.id)), coalesce(r.symbol, upper(r.id)),
      CASE WHEN f.start_date IS NULL THEN 'No price data available'
           ELSE 'Insufficient historical data (starts ' || strftime(f.start_date, '%Y-%m-%d') || ')' END,
      '{_PAGE}/' || upper(coalesce(r.symbol, upper(r.id))) || '/overview'
    FROM recent r LEFT JOIN firsts f ON f.coin_id = r.id
    WHERE lower(r.id) NOT IN (SELECT lower(coin_id) FROM known)
    """,
)
def f13_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = events_daily(spark, sf_dir)
    known = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(
        F.col("s_suppkey").cast("string").alias("coin_id"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").cast("string").alias("symbol"),
        F.lit("Stablecoin").alias("reason"),
        F.lit("").alias("url"),
    )
    recent = cl.without_history_before(_customers(spark, sf_dir), prices, CUTOFF)
    return cl.append_short_history(known, recent, prices)


@query(
    "f11_history_by_quote",
    f"""SELECT * FROM ({_SQL_CUSTOMERS}) WHERE id IN (
      SELECT coin_id FROM ({SQL_EVQ}) WHERE quote = 'CLICK' GROUP BY coin_id HAVING min(date) < DATE '2024-01-10')""",
)
def f11_history_by_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = single_quote(events_daily_by_type(spark, sf_dir), "CLICK")
    return cl.with_history_before(_customers(spark, sf_dir), prices)


@query("f17_limit", f"SELECT * FROM ({SQL_PRT}) ORDER BY p_partkey LIMIT 100")
def f17_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.head(parts(spark, sf_dir), 100, "p_partkey")
