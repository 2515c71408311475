"""Shared by the joins and numberings over time: large groups are cut into parts by quantiles of their order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialise

#: Rows of one key that one task may sort; a larger group is cut.
GROUP_ROWS = 1 << 20
#: Parts of a group; beyond this number they grow instead.
MOST_PARTS = 4096


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def as_number(rows: DataFrame, column: str) -> Column:
    """A date, a time or a number as a number that keeps the order: days, microseconds, or the number itself.

    Whole numbers stay whole, so that nothing is rounded.
    """
    kind = rows.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)")
    if isinstance(kind, T.IntegralType):
        return F.col(column).cast("long")
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return F.col(column)
    raise TypeError(f"{column} is {kind.simpleString()}, not a date, a time or a number")


def large_groups(rows: DataFrame, keys: Sequence[str], order: str, group_rows: int = GROUP_ROWS) -> DataFrame | None:
    """``keys, cuts`` of the groups with more than ``group_rows`` rows, None without any.

    ``cuts`` are ascending quantiles of the numeric ``order``. Counting reads the keys only and adds up before it shuffles;
    a second pass over the large groups alone estimates the quantiles in bounded memory.
    """
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > group_rows)
    large = materialise(counted, "large-groups")
    most = large.agg(F.max("n")).first()[0]
    if most is None:
        return None
    parts = min(-(-most // group_rows), MOST_PARTS)
    shares = [i / parts for i in range(1, parts)]
    ours = matched(rows, large.select(*keys), keys, "left_semi")
    cuts = F.array_sort(F.array_distinct(F.percentile_approx(order, F.lit(shares), 10 * MOST_PARTS)))
    return materialise(ours.groupBy(*keys).agg(cuts.alias("cuts")), "cuts")


def matched(rows: DataFrame, other: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """An equi-join in which NULL keys are equal; the keys of ``other`` are dropped."""
    names = {k: f"_other_{i}" for i, k in enumerate(keys)}
    renamed = other.withColumnsRenamed(names)
    condition = all_of([F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return rows.join(renamed, condition, how).drop(*names.values())


def with_part(rows: DataFrame, cuts: DataFrame | None, keys: Sequence[str], order: str, part: str) -> DataFrame:
    """Rows with the number of their part: how many cuts of their group lie below them. 0 in groups that are not cut."""
    if cuts is None:
        return rows.withColumn(part, F.lit(0))
    below = F.size(F.filter("cuts", lambda c: c < F.col(order)))
    joined = matched(rows, cuts, keys, "left")
    return joined.withColumn(part, F.when(F.col("cuts").isNull(), 0).otherwise(below)).drop("cuts")
