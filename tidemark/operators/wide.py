"""Wide frames, a column for each entity, in blocks of bounded width, and back to long rows.

``wide_frames`` names the columns after the entities, a plan for each block; ``wide_all`` has all blocks in one plan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.numbering import running
from tidemark.session import materialise

#: Columns of a block: a plan stays small, and a row of a block stays within a page.
BLOCK = 500


@dataclass(frozen=True)
class Block:
    """Entities from ``low`` up to but not including ``high`` (None: to the end), in the order of their ids."""

    number: int
    low: str
    high: str | None

    def holds(self, entity: Column) -> Column:
        inside = entity >= F.lit(self.low)
        return inside if self.high is None else inside & (entity < F.lit(self.high))


def blocks(prices: DataFrame, size: int = BLOCK, entity: str = "coin_id") -> list[Block]:
    """Ranges of ids with ``size`` entities each, the last one fewer; only the first id of each comes to the driver.

    Entities are numbered over ranges of ids, so their number is not limited by a task. NULL ids belong to no block.
    """
    if size < 1:
        raise ValueError("a block has at least one entity")
    ids = prices.select(entity).filter(F.col(entity).isNotNull()).distinct()
    numbered = running(ids, [F.asc(entity)], number="_n").filter((F.col("_n") - 1) % size == 0)
    first = sorted((r["_n"], r[entity]) for r in numbered.collect())
    lows = [low for _, low in first]
    return [Block(i, low, high) for i, (low, high) in enumerate(zip(lows, [*lows[1:], None]))]


def wide_block(
    prices: DataFrame, block: Block, value: str = "close", entity: str = "coin_id", date: str = "date", most: int = 10 * BLOCK
) -> DataFrame:
    """``date`` and a column for each entity of the block, one row for each date on which any of them has a row.

    Column names are the ids as they are. The filter on ids reaches the scan. Of several rows of an entity and date any one
    counts; without a row the value is NULL, as it is where it is missing.
    """
    rows = prices.filter(block.holds(F.col(entity))).select(date, entity, value)
    names = sorted(r[0] for r in rows.select(entity).distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"a block of more than {most} entities")
    if date in names:
        raise ValueError(f"an entity is called {date!r}")
    return rows.groupBy(date).pivot(entity, names).agg(F.first(value))


def wide_frames(prices: DataFrame, size: int = BLOCK, value: str = "close", entity: str = "coin_id") -> Iterator[DataFrame]:
    """The blocks of all entities one after the other, each lazy."""
    for block in blocks(prices, size, entity):
        yield wide_block(prices, block, value, entity)


def wide_all(
    prices: DataFrame, size: int = BLOCK, value: str = "close", entity: str = "coin_id", date: str = "date"
) -> tuple[DataFrame, DataFrame]:
    """All blocks in one frame, and the ids of their columns: one plan, however many entities there are.

    The frame has ``block, date, c0 .. c<size - 1>``, one row for each block and date on which any entity of the block has a
    row; the ids are ``block, place, <entity>``, in their order. Only the number of columns comes to the driver.
    """
    if size < 1:
        raise ValueError("a block has at least one entity")
    ids = prices.select(F.col(entity).alias("id")).filter(F.col("id").isNotNull()).distinct()
    at = F.col("_n") - 1
    names = running(ids, [F.asc("id")], number="_n").select(
        F.floor(at / size).alias("block"), (at % size).cast("int").alias("place"), F.col("id").alias(entity)
    )
    names = materialise(names, "wide-names")
    places = range((names.agg(F.max("place")).first()[0] or 0) + 1)  # one column without entities
    rows = prices.select(entity, F.col(date).alias("date"), F.col(value).alias("value")).join(names, entity)
    wide = rows.groupBy("block", "date").pivot("place", list(places)).agg(F.first("value"))
    return wide.select("block", F.col("date").alias(date), *[F.col(f"`{i}`").alias(f"c{i}") for i in places]), names


def long_all(
    wide: DataFrame, names: DataFrame, value: str = "close", entity: str = "coin_id", date: str = "date"
) -> DataFrame:
    """The rows of a frame of all blocks: one for each date and entity that has a value."""
    cells = F.array(*[F.col(c) for c in wide.columns if c not in ("block", date)])
    long = wide.select("block", F.col(date), F.posexplode(cells).alias("place", value)).filter(F.col(value).isNotNull())
    return long.join(names, ["block", "place"]).select(entity, date, value)


def long_rows(wide: DataFrame, value: str = "close", entity: str = "coin_id", date: str = "date") -> DataFrame:
    """The rows of a wide block: one for each date and entity that has a value."""
    names: Sequence[str] = [c for c in wide.columns if c != date]
    if not names:
        return wide.select(F.lit("").alias(entity), date, F.lit(None).cast("double").alias(value)).limit(0)
    long = wide.unpivot([date], [F.col(f"`{n}`") for n in names], entity, value)
    return long.filter(F.col(value).isNotNull()).select(entity, date, value)
