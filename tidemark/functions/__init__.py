"""Column expressions shared by the operators. All are native Spark expressions."""

from tidemark.functions.dates import (
    cycle_label,
    day_number,
    half_month_start,
    month_key,
    month_label,
    month_partition,
    unix_date,
)
from tidemark.functions.numeric import clean_double, magnitude_label
from tidemark.functions.text import pair_name_fields, reason_bucket, sanitise_id

__all__ = [
    "clean_double",
    "cycle_label",
    "day_number",
    "half_month_start",
    "magnitude_label",
    "month_key",
    "month_label",
    "month_partition",
    "pair_name_fields",
    "reason_bucket",
    "sanitise_id",
    "unix_date",
]
