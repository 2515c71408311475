"""Numbers, neighbours and running totals over a total order of all rows, without putting them into one partition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialise

#: Low bits of the number that Spark gives to the rows of a partition; the partition is above them.
_PLACE_BITS = 33


def _starts(edges: list, totals: int, previous: int, following: int) -> list[tuple]:
    """What each range starts from: rows and totals of all before it, the last values before and the first behind it."""
    edges = sorted(edges, key=lambda r: r["_part"])
    out, rows, sums = [], 0, [None] * totals
    for i, r in enumerate(edges):
        lasts = [edges[i - 1][f"_last_{j}"] if i else None for j in range(previous)]
        firsts = [edges[i + 1][f"_first_{j}"] if i + 1 < len(edges) else None for j in range(following)]
        out.append((r["_part"], rows, *sums, *lasts, *firsts))
        rows += r["_rows"]
        own = [r[f"_total_{j}"] for j in range(totals)]
        sums = [a if b is None else b if a is None else a + b for a, b in zip(sums, own)]
    return out


def _start_schema(edges: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in edges.schema.fields])


def running(
    rows: DataFrame,
    order: Sequence[Column],
    number: str | None = "number",
    totals: Mapping[str, str] | None = None,
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Rows with their number from 1 in the ``order`` of all rows, running totals, and values of their neighbours.

    ``totals`` maps new columns to the numeric columns that are added up to the row itself (NULL adds nothing; before the
    first value NULL); ``previous`` and ``following`` map new columns to the columns whose value the row before or after
    has. ``order`` must be a total order of the rows, or ties are broken arbitrarily (but in one way for all columns).
    An empty table gives no rows.

    Two passes. Rows are sorted by ranges of the order and written to the shared folder with their place; one row of totals and
    edge values per range gives what each range starts from: only these, as many as there are ranges, reach the driver.
    """
    totals, previous, following = dict(totals or {}), dict(previous or {}), dict(following or {})
    made = [*totals, *previous, *following, *([number] if number else [])]
    if clash := set(made) & set(rows.columns) or {m for m in made if made.count(m) > 1}:
        raise ValueError(f"columns that exist already or twice: {sorted(clash)}")
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order)
    # Numbered names, so that none meets one of those made here.
    own = {c: f"c{i}" for i, c in enumerate(rows.columns)}
    totals, previous, following = ({n: own[c] for n, c in m.items()} for m in (totals, previous, following))
    placed = materialise(
        ranged.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], F.monotonically_increasing_id().alias("_id")), "ordered"
    )
    placed = placed.withColumn("_part", F.shiftright("_id", _PLACE_BITS))
    place = F.col("_id").bitwiseAND((1 << _PLACE_BITS) - 1)

    edges = placed.groupBy("_part").agg(
        F.count("*").alias("_rows"),
        *[F.sum(c).alias(f"_total_{i}") for i, c in enumerate(totals.values())],
        *[F.max_by(F.struct(c), "_id").alias(f"_last_{i}") for i, c in enumerate(previous.values())],
        *[F.min_by(F.struct(c), "_id").alias(f"_first_{i}") for i, c in enumerate(following.values())],
    )
    starts = rows.sparkSession.createDataFrame(_starts(edges.collect(), len(totals), len(previous), len(following)), _start_schema(edges))
    out = placed.join(F.broadcast(starts), "_part")  # one row per range
    inside = Window.partitionBy("_part").orderBy("_id")
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns: dict[str, Column] = {}
    if number:
        columns[number] = F.col("_rows") + place + 1
    for i, (name, c) in enumerate(totals.items()):
        here, before = F.sum(c).over(whole), F.col(f"_total_{i}")
        columns[name] = F.coalesce(before + here, before, here)
    for i, (name, c) in enumerate(previous.items()):
        columns[name] = F.coalesce(F.lag(F.struct(c)).over(inside), F.col(f"_last_{i}"))[c]
    for i, (name, c) in enumerate(following.items()):
        columns[name] = F.coalesce(F.lead(F.struct(c)).over(inside), F.col(f"_first_{i}"))[c]
    names = {n: f"m{i}" for i, n in enumerate(columns)}
    out = out.withColumns({names[n]: c for n, c in columns.items()})
    return out.select(*[F.col(n).alias(c) for c, n in (*own.items(), *names.items())])
