"""Composition and status reports. Every function returns the data of a page, not the page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import magnitude_label, month_key, month_label, reason_bucket


def months(composition: DataFrame) -> DataFrame:
    """Distinct months with their display name and a flag for the latest one."""
    keys = composition.select(
        month_key(F.col("date")).alias("month"), month_label(F.col("date")).alias("month_label")
    ).distinct()
    newest = composition.select(month_key(F.max("date"))).scalar()
    return keys.withColumn("is_latest", F.col("month") == newest)


def month_rows(composition: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of the month pages: upper-case id, weight in percent, index value of the date or NULL."""
    return composition.join(index.select("date", "index_price"), "date", "left").select(
        month_key(F.col("date")).alias("month"),
        "date",
        "rank",
        F.upper("coin_id").alias("coin_id"),
        "volume",
        (F.col("weight") * 100).alias("weight_pct"),
        "price",
        "index_price",
    )


def write_month_rows(rows: DataFrame, path: str) -> None:
    """One JSON folder per month; a re-run replaces only the months it contains.

    ``rebalance`` lets AQE split a month that is too large for one task and merge small ones.
    """
    (
        rows.hint("rebalance", F.col("month"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month")
        .json(path)
    )


def _date_steps(composition: DataFrame) -> DataFrame:
    """One row per available date with its number and neighbours. At most one row per calendar date."""
    order = Window.orderBy("date")
    return (
        composition.select("date")
        .distinct()
        .select(
            "date",
            F.row_number().over(order).alias("step"),
            F.lag("date").over(order).alias("previous_date"),
            F.lead("date").over(order).alias("next_date"),
        )
    )


def previous_dates(composition: DataFrame) -> DataFrame:
    """The date each available date is compared with, and whether that lies in another month."""
    steps = _date_steps(composition)
    return steps.select(
        "date",
        "previous_date",
        F.coalesce(
            month_key(F.col("previous_date")) != month_key(F.col("date")), F.lit(False)
        ).alias("carried_over"),
    )


def membership_changes(composition: DataFrame) -> DataFrame:
    """One row per entity entering (``added``) or leaving (``removed``) versus the previous AVAILABLE date.

    Dates are numbered once; an entity is added where its previous number is not the one before, and
    removed on the date after its last consecutive one. One window per entity instead of comparing all
    pairs of day sets. Nothing is reported for the first available date.
    """
    steps = _date_steps(composition)
    own = Window.partitionBy("coin_id").orderBy("step")
    # One row per calendar date at most, hence small whatever the number of entities.
    runs = (
        composition.select("date", "coin_id", "rank")
        .join(F.broadcast(steps), "date")
        .select(
            "*",
            F.lag("step").over(own).alias("_before"),
            F.lead("step").over(own).alias("_after"),
        )
    )
    entered = (F.col("step") > 1) & ~F.col("_before").eqNullSafe(F.col("step") - 1)
    left = F.col("next_date").isNotNull() & ~F.col("_after").eqNullSafe(F.col("step") + 1)
    changes = F.array(
        F.when(entered, F.struct(F.col("date").alias("date"), F.lit("added").alias("change"))),
        F.when(left, F.struct(F.col("next_date").alias("date"), F.lit("removed").alias("change"))),
    )
    return (
        runs.select("coin_id", "rank", F.explode(changes).alias("_c"))
        .filter(F.col("_c").isNotNull())
        .select("_c.date", "_c.change", "coin_id", "rank")
    )


def membership_summary(composition: DataFrame) -> DataFrame:
    """Added and removed members per date as text: 'None' when empty, 'N/A (first day)' on the first.

    A list holds at most the members of one day (top_n).
    """

    def names(change: str):
        ranked = F.array_sort(
            F.collect_list(
                F.when(
                    F.col("change") == change, F.struct("rank", F.upper("coin_id").alias("coin"))
                )
            )
        )
        return F.array_join(F.transform(ranked, lambda m: m["coin"]), ", ")

    changes = (
        membership_changes(composition)
        .groupBy("date")
        .agg(names("added").alias("added"), names("removed").alias("removed"))
    )
    first = F.col("previous_date").isNull()

    def text(name: str):
        listed = F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("None"))
        return F.when(first, F.lit("N/A (first day)")).otherwise(listed).alias(name)

    return (
        _date_steps(composition)
        .join(changes, "date", "left")
        .select("date", "previous_date", text("added"), text("removed"))
    )


def day_totals(composition: DataFrame) -> DataFrame:
    return composition.groupBy("date").agg(
        F.count(F.lit(1)).alias("member_count"), F.sum("volume").alias("listed_volume")
    )


def availability_grid(composition: DataFrame) -> DataFrame:
    """Year x month: whether any date of the month is available."""
    present = [F.bool_or(F.month("date") == m).alias(f"m{m:02d}") for m in range(1, 13)]
    return composition.groupBy(F.year("date").alias("year")).agg(*present)


def status_rows(accepted: DataFrame, coverage: DataFrame) -> DataFrame:
    """Accepted entities that have prices, at their position in the list, with their coverage."""
    covered = coverage.withColumnRenamed("coin_id", "_coin")
    return accepted.join(covered, F.lower("id") == F.col("_coin")).select(
        "position",
        "id",
        "symbol",
        "name",
        magnitude_label(F.col("market_cap")).alias("market_cap_label"),
        "start_date",
        "end_date",
        "days",
    )


def report_counters(accepted: DataFrame, skipped: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row: total, with price data, skipped, accepted."""
    covered = coverage.select(F.col("coin_id").alias("_coin"))
    n_skipped = skipped.select(F.count(F.lit(1))).scalar()
    return (
        accepted.join(covered, F.lower("id") == F.col("_coin"), "left")
        .agg(
            F.count(F.lit(1)).alias("accepted"),
            F.count("_coin").alias("with_data"),
        )
        .withColumn("skipped", n_skipped)
        .select(
            (F.col("accepted") + F.col("skipped")).alias("total"), "with_data", "skipped", "accepted"
        )
    )


def skipped_buckets(skipped: DataFrame) -> DataFrame:
    return skipped.withColumn("bucket", reason_bucket(F.col("reason")))


def dataset_status(prices: DataFrame, index: DataFrame) -> DataFrame:
    """One row: entities, pairs, and the index's days and range."""
    pairs = prices.select("coin_id", "quote").distinct()
    return index.agg(
        F.count(F.lit(1)).alias("index_days"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    ).select(
        pairs.select(F.count_distinct("coin_id")).scalar().alias("n_entities"),
        pairs.select(F.count(F.lit(1))).scalar().alias("n_pairs"),
        "index_days",
        "first_date",
        "last_date",
    )
