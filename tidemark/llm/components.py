"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(arcs: DataFrame, larger: bool) -> DataFrame:
    """Every node's neighbours are linked to the least node around it: its larger ones, or itself and its smaller ones.

    The least is an aggregate and comes back by a join, so a hub is never gathered in one task.
    """
    least = arcs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = arcs.join(least, "a")
    if larger:
        out = moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return out.filter(F.col("a") != F.col("b")).distinct()


def stars(links: DataFrame, label: str = "links") -> DataFrame:
    """Links ``a, b`` (long) turned into ``a -> b`` with ``b`` the least node of the component of ``a``.

    The least nodes themselves have no row. Each round is written to the shared folder, which cuts the
    lineage and survives lost executors; only a count and a checksum reach the driver. The number of
    rounds grows with the logarithm of the size of a component.
    """
    links = materialise(
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        label,
    )
    state = _state(links)
    while state[0]:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = materialise(_star(both, larger=True), label)
        links = materialise(_star(large.filter(F.col("b") < F.col("a")), larger=False), label)
        following = _state(links)
        if following == state:
            break
        state = following
    return links
