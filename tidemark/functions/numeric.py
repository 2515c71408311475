"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_double(value: Column) -> Column:
    """NULL for NaN. Files written from NumPy mark missing values with NaN, which Spark would sum."""
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def magnitude_label(amount: Column) -> Column:
    """``$1.23B`` / ``$4.56M`` / ``$7,890``; a missing amount counts as 0.

    ``format_number`` rounds the binary value half-even, as most languages print it; ``format_string``
    would round the shortest decimal text half-up.
    """
    value = F.coalesce(amount.cast("double"), F.lit(0.0))

    def scaled(unit: float, suffix: str) -> Column:
        digits = F.call_function("format_number", value / F.lit(unit), F.lit("0.00"))
        return F.concat(F.lit("$"), digits, F.lit(suffix))

    return (
        F.when(value >= 1e9, scaled(1e9, "B"))
        .when(value >= 1e6, scaled(1e6, "M"))
        .otherwise(F.concat(F.lit("$"), F.format_number(value, 0)))
    )
