"""As-of joins: every row meets the nearest row of another table at or before its time, at or after it, or either."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.spread import GROUP_ROWS, all_of, as_number, large_groups, with_part

DIRECTIONS = ("backward", "forward", "nearest")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: Sequence[str] = (),
    direction: str = "backward",
    tolerance: int | float | None = None,
    strict: bool = False,
    right_on: str | None = None,
    how: str = "left",
    suffix: str = "_right",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Every row of ``left`` with the row of ``right`` of equal ``by`` whose time is nearest in ``direction``.

    "backward" looks at times up to the own one, "forward" from it on, "nearest" at both (a tie goes to the earlier).
    With ``strict`` an equal time does not count. ``tolerance`` bounds the distance: days for dates, microseconds for
    times, else the unit of the numbers. The result has the columns of ``left``, then those of ``right`` but ``by``; names that
    ``left`` has too get ``suffix``. ``how`` "inner" leaves rows without a partner out.

    NULL keys match nothing, nor do NULL times; such rows of ``left`` stay without a partner. Of several rows of ``right``
    at one time the greatest by its columns, in their order, is the partner. Repeated rows of ``left`` repeat.

    Both sides are put into one table, sorted by key and time in one shuffle, and the last row of ``right`` is carried along:
    a row is never compared with more than its neighbour. A key with more than ``group_rows`` rows is cut by time into
    parts that are sorted by different tasks; what a part inherits is carried over a summary of one row per part.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    right_on = right_on or on
    payload = [c for c in right.columns if c not in by]
    keys = [f"_k{i}" for i in range(max(1, len(by)))]  # without keys all rows are of one group
    if left.schema[on].dataType != right.schema[right_on].dataType:
        raise TypeError("the times of both sides must be of one type")

    kind = right.select(F.struct(*payload).alias("r")).schema["r"].dataType
    own = left.select(
        *[F.col(c).alias(k) for c, k in zip(by, keys)] or [F.lit(0).alias(keys[0])],
        as_number(left, on).alias("_t"),
        F.lit(1).alias("_side"),
        F.struct(*left.columns).alias("_l"),
        F.lit(None).cast(kind).alias("_r"),
    )
    known = all_of([F.col(c).isNotNull() for c in (right_on, *by)])
    other = right.filter(known).select(
        *[F.col(c).alias(k) for c, k in zip(by, keys)] or [F.lit(0).alias(keys[0])],
        as_number(right, right_on).alias("_t"),
        F.lit(0).alias("_side"),
        F.lit(None).cast(own.schema["_l"].dataType).alias("_l"),
        F.struct(*payload).alias("_r"),
    )
    # Rows that match nothing need no order.
    can_match = all_of([F.col(c).isNotNull() for c in ("_t", *keys)])
    both = own.filter(can_match).unionByName(other)
    cuts = large_groups(both.select(*keys, "_t"), keys, "_t", group_rows)
    both = with_part(both, cuts, keys, "_t", "_part")
    group = Window.partitionBy(*keys, "_part")
    partner = F.struct(F.col("_t").alias("t"), F.col("_r").alias("r"))
    partner = F.when(F.col("_side") == 0, partner)

    directions = {"backward": ("b",), "forward": ("f",), "nearest": ("b", "f")}[direction]
    out = both
    carried = {}
    for d in directions:
        # At an equal time rows of the right come first, unless they do not count; the partner is the last in this order.
        side = F.col("_side") if not strict else -F.col("_side")
        order = [F.asc("_t"), side.asc(), F.asc_nulls_first("_r")] if d == "b" else [F.desc("_t"), side.asc(), F.asc_nulls_first("_r")]
        so_far = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = F.last(partner, ignorenulls=True).over(so_far)
        out = out.withColumn(f"_{d}", found)
        if cuts is not None:
            carried[d] = _inherited(both, keys, partner, d)
    out = out.filter(F.col("_side") == 1)
    for d, table in carried.items():
        names = {k: f"_i{i}" for i, k in enumerate([*keys, "_part"])}
        table = table.withColumnsRenamed(names)
        same = all_of([F.col(k) == F.col(n) for k, n in names.items()])
        out = out.join(table, same, "left").withColumn(f"_{d}", F.coalesce(f"_{d}", f"_inherited_{d}"))
        out = out.drop(f"_inherited_{d}", *names.values())

    def distance(d: str):
        return F.abs(F.col("_t") - F.col(f"_{d}.t"))

    if direction == "nearest":
        later = F.col("_b").isNull() | (distance("f") < distance("b"))
        best = F.when(later & F.col("_f").isNotNull(), F.col("_f")).otherwise(F.col("_b"))
    else:
        best = F.col(f"_{directions[0]}")
    out = out.withColumn("_best", best)
    if tolerance is not None:
        near = F.abs(F.col("_t") - F.col("_best.t")) <= F.lit(tolerance)
        out = out.withColumn("_best", F.when(near, F.col("_best")))
    names = [(c, c if c not in left.columns else c + suffix) for c in payload]
    shown = [F.col("_l")[c].alias(c) for c in left.columns]
    result = out.select("_l", F.col("_best.r").alias("_r"))
    if how == "inner":
        result = result.filter(F.col("_r").isNotNull())
    else:
        alone = own.filter(~can_match).select("_l", F.lit(None).cast(kind).alias("_r"))
        result = result.unionByName(alone)
    return result.select(*shown, *[F.col("_r")[c].alias(n) for c, n in names])


def _inherited(both: DataFrame, keys: Sequence[str], partner, d: str) -> DataFrame:
    """What each part of a group takes over from the parts before it (after it): one row per part.

    The nearest row of the right in each part is an aggregate that is reduced before the shuffle.
    """
    at = F.struct(F.col("_t") if d == "b" else -F.col("_t"), F.col("_r"))
    summary = both.groupBy(*keys, "_part").agg(F.max_by(partner, F.when(F.col("_side") == 0, at)).alias("_own"))
    part = F.asc("_part") if d == "b" else F.desc("_part")
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(*keys, "_part", F.last("_own", ignorenulls=True).over(before).alias(f"_inherited_{d}"))
