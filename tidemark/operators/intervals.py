"""Joins of points with a table of intervals that contain them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.spread import as_number
from tidemark.session import materialise

CLOSED = ("both", "left", "right", "neither")
#: Buckets of one level are so many times as wide as those of the level below.
STEP = 4


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    at: str,
    start: str,
    end: str,
    by: Sequence[str] = (),
    closed: str = "both",
    suffix: str = "_interval",
) -> DataFrame:
    """Every pair of a point and an interval that contains it: the columns of both.

    ``at`` is a date, a time or a number of ``points``, ``start`` and ``end`` are of the same type in ``intervals``; ``by`` are
    further columns that must be equal. ``closed`` says which ends belong to an interval. Columns of ``intervals`` whose
    name ``points`` has too get ``suffix``; ``by`` appears once. NULL times and keys match nothing, and neither does
    an interval that ends before it starts. Repeated rows repeat.

    Time is cut into buckets. An interval belongs to the level whose buckets are at least as wide as it is long, so it
    touches at most two of them; a point meets the buckets of the levels that occur. There are as many levels as
    powers of STEP between the shortest and the longest interval, so neither side grows with their lengths. Pairs that
    meet are checked exactly. Large buckets are split by the skew handling of adaptive execution.
    """
    if closed not in CLOSED:
        raise ValueError(f"closed must be one of {CLOSED}")
    if len({points.schema[at].dataType, intervals.schema[start].dataType, intervals.schema[end].dataType}) > 1:
        raise TypeError("point, start and end must be of one type")
    keys = [f"_k{i}" for i in range(len(by))]
    spans = intervals.select(
        *[F.col(c).alias(k) for c, k in zip(by, keys)],
        as_number(intervals, start).alias("_s"),
        as_number(intervals, end).alias("_e"),
        F.struct(*intervals.columns).alias("_interval"),
    ).filter(F.col("_s") <= F.col("_e"))
    # Level n has buckets of width unit * STEP^n; the shortest length that is not 0 gives the unit.
    length = F.col("_e") - F.col("_s")
    shortest = spans.agg(F.min(F.when(length > 0, length))).first()[0]
    unit = float(shortest) if shortest else 1.0
    level = F.when(length <= unit, F.lit(0)).otherwise(F.ceil(F.log(float(STEP), length / F.lit(unit)) + 1e-9)).cast("int")
    spans = spans.withColumn("_level", F.greatest(level, F.lit(0)))
    spans = materialise(spans, "intervals")
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())  # a few dozen at most
    width = F.lit(unit) * F.pow(F.lit(float(STEP)), F.col("_level"))

    def bucket(value: Column) -> Column:
        return F.floor(value / width).cast("long")

    spans = spans.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_s")), bucket(F.col("_e")))))
    rows = points.select(
        *[F.col(c).alias(k) for c, k in zip(by, keys)],
        as_number(points, at).alias("_t"),
        F.struct(*points.columns).alias("_point"),
    ).filter(F.col("_t").isNotNull())
    rows = rows.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    rows = rows.withColumn("_bucket", bucket(F.col("_t")))
    after = F.col("_t") >= F.col("_s") if closed in ("both", "left") else F.col("_t") > F.col("_s")
    before = F.col("_t") <= F.col("_e") if closed in ("both", "right") else F.col("_t") < F.col("_e")
    met = rows.join(spans, [*keys, "_level", "_bucket"]).filter(after & before)
    names = [(c, c if c not in points.columns else c + suffix) for c in intervals.columns if c not in by]
    return met.select(
        *[F.col("_point")[c].alias(c) for c in points.columns], *[F.col("_interval")[c].alias(n) for c, n in names]
    )
