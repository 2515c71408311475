"""Schemas of the data model. Sources always read with an explicit schema, never by inference."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L, _I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


OHLCV = ("open", "high", "low", "close", "volume_from", "volume_to")

# One row per (coin_id, quote, date)
PRICES = _struct(("coin_id", _S), ("quote", _S), ("date", T.DateType()), *((c, _D) for c in OHLCV))

# Rows decoded from the file-per-pair layout
PAIR_FILE_ROWS = _struct(("file", _S), ("date", T.DateType()), *((c, _D) for c in OHLCV))

ENTITY = _struct(
    ("id", _S),
    ("symbol", _S),
    ("name", _S),
    ("market_cap", _D),
    ("market_cap_rank", _I),
    ("current_price", _D),
    ("volume_24h", _D),
    ("circulating_supply", _D),
)

SKIPPED = _struct(("coin_id", _S), ("name", _S), ("symbol", _S), ("reason", _S), ("url", _S))

INDEX = _struct(("date", T.DateType()), ("index_price", _D), ("total_volume", _D), ("coin_count", _L))

COMPOSITION = _struct(
    ("date", T.DateType()), ("rank", _I), ("coin_id", _S), ("volume", _D), ("weight", _D), ("price", _D)
)

# Landed history page: {Response, Message, Data: {Data: [{time, open, ...}]}}
HISTORY_RECORD = _struct(
    ("time", _L),
    ("open", _D),
    ("high", _D),
    ("low", _D),
    ("close", _D),
    ("volumefrom", _D),
    ("volumeto", _D),
)
HISTORY_PAGE = _struct(
    ("Response", _S), ("Message", _S), ("Data", _struct(("Data", T.ArrayType(HISTORY_RECORD))))
)

# Landed ranking page: {Data: [{CoinInfo: {...}, RAW: {<quote>: {...}}}]}
RANKING_RECORD = _struct(
    ("CoinInfo", _struct(("Name", _S), ("FullName", _S))),
    # Fields per quote stay a map: an EMPTY entry has to be told from one with missing fields.
    ("RAW", T.MapType(_S, T.MapType(_S, _S))),
)
RANKING_PAGE = _struct(("Response", _S), ("Message", _S), ("Data", T.ArrayType(RANKING_RECORD)))

# Landed symbol dictionary: {Data: {<symbol>: {...}}}
SYMBOL_INFO = _struct(("Id", _S), ("Name", _S), ("Symbol", _S), ("CoinName", _S), ("FullName", _S))
SYMBOL_DICTIONARY = _struct(("Response", _S), ("Message", _S), ("Data", T.MapType(_S, SYMBOL_INFO)))
