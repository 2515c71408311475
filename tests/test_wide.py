"""Wide blocks and back."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import wide


def test_back_from_wide_to_long(spark):
    """2000 entities in blocks of 700: every row with a value comes back, and each block is as wide as it may be."""
    rows = spark.range(2000 * 4).select(
        F.concat(F.lit("c."), (F.col("id") % 2000).cast("string")).alias("coin_id"),
        F.date_add(F.to_date(F.lit("2024-01-01")), F.floor(F.col("id") / 2000).cast("int")).alias("date"),
        F.when(F.col("id") % 11 > 0, F.col("id") / 8).alias("close"),
    )
    found = wide.blocks(rows, 700)
    assert [b.number for b in found] == [0, 1, 2] and found[0].low == "c.0" and found[-1].high is None
    frames = list(wide.wide_frames(rows, 700))
    assert [len(f.columns) for f in frames] == [701, 701, 601]
    back = wide.long_rows(frames[0])
    for f in frames[1:]:
        back = back.unionByName(wide.long_rows(f))
    kept = rows.filter("close IS NOT NULL")
    assert back.count() == kept.count() and back.exceptAll(kept).isEmpty()


def test_odd_tables(spark):
    none = spark.createDataFrame([], "coin_id string, date date, close double")
    assert wide.blocks(none) == [] and list(wide.wide_frames(none)) == []
    some = spark.sql("SELECT * FROM VALUES ('a', DATE '2024-01-01', 1.0D), (NULL, DATE '2024-01-02', 2.0D) AS t(coin_id, date, close)")
    (block,) = wide.blocks(some)
    frame = wide.wide_block(some, block)
    assert frame.columns == ["date", "a"] and frame.count() == 1
    assert wide.long_rows(frame.select("date")).count() == 0
    with pytest.raises(ValueError):
        wide.blocks(some, 0)
    with pytest.raises(ValueError):
        wide.wide_block(some, block, most=0)
