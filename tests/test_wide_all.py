"""All wide blocks in one plan, and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import wide


def _rows(spark, entities):
    return spark.range(entities * 3).select(
        F.concat(F.lit("c."), (F.col("id") % entities).cast("string")).alias("coin_id"),
        F.date_add(F.to_date(F.lit("2024-01-01")), F.floor(F.col("id") / entities).cast("int")).alias("date"),
        F.when(F.col("id") % 11 > 0, F.col("id") / 8).alias("close"),
    )


def test_the_plan_does_not_grow_with_the_entities(spark, plan_of):
    """200 blocks and two: plans of the same length, so that the driver holds no more for many blocks."""
    sizes = []
    for entities in (20, 2000):
        rows = _rows(spark, entities)
        frame, names = wide.wide_all(rows, 10)
        assert frame.columns == ["block", "date", *[f"c{i}" for i in range(10)]] and names.count() == entities
        assert frame.select("block").distinct().count() == entities // 10
        back, kept = wide.long_all(frame, names), rows.filter("close IS NOT NULL")
        assert back.count() == kept.count() and back.exceptAll(kept).isEmpty()
        sizes.append(plan_of(back).count("\n"))
    assert sizes[0] == sizes[1]


def test_names_are_in_the_order_of_ids(spark):
    rows = _rows(spark, 25)
    names = wide.wide_all(rows, 10)[1].orderBy("block", "place").collect()
    assert [r["coin_id"] for r in names] == sorted(f"c.{i}" for i in range(25))
    assert [(r["block"], r["place"]) for r in names] == [(i // 10, i % 10) for i in range(25)]


def test_odd_tables(spark):
    none = spark.createDataFrame([], "coin_id string, date date, close double")
    assert wide.long_all(*wide.wide_all(none)).collect() == []
    some = spark.sql("SELECT * FROM VALUES ('a', DATE '2024-01-01', 1.0D), (NULL, DATE '2024-01-02', 2.0D) AS t(coin_id, date, close)")
    assert [tuple(r)[::2] for r in wide.long_all(*wide.wide_all(some)).collect()] == [("a", 1.0)]
