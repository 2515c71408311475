"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.params import DEFAULT_QUOTE

_PAIR_NAME = r"^(.*)-([^-]*)$"


def sanitise_id(identifier: Column) -> Column:
    """Every character that is neither a letter, a digit, ``-`` nor ``_`` becomes ``_``."""
    return F.regexp_replace(identifier, r"[^\p{L}\p{N}_-]", "_")


def pair_name_fields(file_name: Column) -> tuple[Column, Column, Column]:
    """``(coin_id, QUOTE, is_legacy)`` of a file name such as ``eth-btc.parquet``.

    The split is at the LAST hyphen, so a legacy id that contains one reads as a pair.
    A name without any hyphen is a legacy file, which always holds the default quote.
    """
    stem = F.regexp_replace(file_name, r"\.parquet$", "")
    legacy = ~stem.contains("-")
    coin = F.when(legacy, stem).otherwise(F.regexp_extract(stem, _PAIR_NAME, 1))
    quote = F.when(legacy, F.lit(DEFAULT_QUOTE)).otherwise(F.upper(F.regexp_extract(stem, _PAIR_NAME, 2)))
    return coin, quote, legacy


def reason_bucket(reason: Column) -> Column:
    """Report bucket of a skip reason; the tests run in this order."""
    text = F.coalesce(reason, F.lit("Unknown"))
    return (
        F.when(text.contains("BTC") | text.contains("Bitcoin"), "btc")
        .when(text.contains("Stablecoin"), "stablecoin")
        .when(F.lower(text).contains("historical") | text.contains("Insufficient"), "history")
        .otherwise("wrapped")
    )
