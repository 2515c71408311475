"""Date expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_number(day: Column) -> Column:
    """Days since 1970-01-01, a number that calendar gaps can be read from."""
    return F.unix_date(day)


def unix_date(seconds: Column) -> Column:
    """UTC date of unix ``seconds``, whatever the session time zone is."""
    return F.date_from_unix_date(F.floor(seconds / F.lit(86400)).cast("int"))


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy_MM")


def month_label(day: Column) -> Column:
    return F.date_format(day, "MMM yyyy")


def month_partition(day: Column) -> Column:
    """Value of the ``month`` partition column of the stores."""
    return F.date_format(day, "yyyy-MM")


def half_month_start(day: Column) -> Column:
    """The 1st for days 1-14, the 15th for the rest."""
    first = F.trunc(day, "MM")
    return F.when(F.dayofmonth(day) < 15, first).otherwise(F.date_add(first, 14))


def cycle_label(day: Column, cycles: Iterable) -> Column:
    """``C3: Day 880 | C4: Day -5`` over the given cycles, '' outside all of them.

    The cycles are a short list of parameters, so this is one expression and needs no join.
    """
    parts = [
        F.when(
            day.between(F.lit(c.start), F.lit(c.end)),
            F.concat(F.lit(f"C{c.number}: Day "), F.datediff(day, F.lit(c.anchor)).cast("string")),
        )
        for c in cycles
    ]
    return F.concat_ws(" | ", *parts) if parts else F.lit("")
