"""Exact top-k search by a Voronoi kNN join, for the inner product of integer vectors.

Vectors belong to the cell of their nearest pivot. From summaries of the cells (the distances of the few
vectors nearest to the pivot) each query gets a score it is sure to reach, and from it the least distance
from the pivot at which a vector of a cell can still matter. Queries are grouped by pivot; a group receives
only the vectors beyond the least such distance of its members, and solves locally.

For a vector x of the cell of pivot p at distance d, |<q,x> - <q,p>| <= |q| d.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ship
from tidemark.llm.vectors import PARTIAL, best, matrix, merged, vectors
from tidemark.session import materialise

#: Cells, and the rows of the sample from which the pivots are taken. Neither grows with the table.
PIVOTS, PIVOT_SAMPLE = 64, 4096
#: Vectors and queries that meet in one task.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048
_CELLS = "vec_id long, vector array<double>, cell int, distance double"
#: Distances and bounds are rounded to the safe side by this share.
_SLACK = 1e-9


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Vectors of the sample, each the farthest from those already chosen; fewer if there are not so many."""
    chosen = [0]
    nearest = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _assigned(batches, pivots: list[list[float]]):
    p = np.array(pivots)
    for frame in batches:
        if len(frame):
            x = matrix(frame["vector"])
            # In blocks, the squared distances to all pivots.
            cell = ((p * p).sum(1) - 2 * x @ p.T).argmin(1)
            frame["cell"] = cell.astype(np.int32)
            frame["distance"] = np.sqrt(((x - p[cell]) ** 2).sum(1)) * (1 + _SLACK)
            yield frame[["vec_id", "vector", "cell", "distance"]]


def _reach(batches, pivots: list[list[float]], cells: list[int], nearest: list[float], ids: list[int], k: int):
    """For each query and cell, the least distance from the pivot that can matter; the least per batch and group."""
    p, of, d, owners = np.array(pivots), np.array(cells), np.array(nearest), np.array(ids)
    for frame in batches:
        if not len(frame):
            continue
        q = matrix(frame["vector"])
        norm = np.sqrt((q * q).sum(1)) * (1 + _SLACK)
        to_pivot = q @ p.T
        sure = to_pivot[:, of] - norm[:, None] * d
        # Rows that share the query's id are no candidates.
        sure[owners == frame["vec_id"].to_numpy()[:, None]] = -np.inf
        bound = np.sort(sure, axis=1)[:, -k] if len(of) >= k else np.full(len(q), -np.inf)
        with np.errstate(divide="ignore", invalid="ignore"):
            need = (bound[:, None] - to_pivot) / norm[:, None]
        # A zero query scores 0 everywhere: everything matters.
        need = np.where(norm[:, None] > 0, need - 1e-6 * (1 + np.abs(need)), -np.inf)
        need = np.nan_to_num(need, nan=-np.inf, neginf=-1e300)
        group = frame["cell"].to_numpy()
        for g in np.unique(group):
            least = need[group == g].min(0)
            yield pd.DataFrame({"group": np.int32(g), "cell": np.arange(len(p), dtype=np.int32), "least": least})


def _solve(_key, data: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(data) or not len(asked):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    x, ids = matrix(data["vector"]), data["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    queries, query_ids = matrix(asked["query"]), asked["query_id"].to_numpy()
    found = []
    for start in range(0, len(queries), 256):
        # Whole numbers below 2^53: exact in double precision, in any order of summation.
        scores = queries[start : start + 256] @ x.T
        for i, row in enumerate(scores):
            query_id = query_ids[start + i]
            row[np.searchsorted(ids, query_id) : np.searchsorted(ids, query_id, "right")] = -np.inf
            chosen = best(row, ids, k)
            chosen = chosen[row[chosen] > -np.inf]
            found.append((np.full(len(chosen), query_id), ids[chosen], row[chosen]))
    q, v, s = (np.concatenate(c) for c in zip(*found))
    return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})


def knn_join(
    table: DataFrame, is_query: Column, k: int = 20, scale: int = 64, pivots: int = PIVOTS
) -> DataFrame:
    """For every query row the k rows of highest integer inner product: ``query_id, rank, vec_id, score``.

    Each component x becomes ``floor(scale * x)``, x as double. ``is_query`` is a condition on ``vec_id``.
    Every row but the query's own is a candidate; ties go to the smaller id. Vectors that are NULL, empty,
    not of the commonest length, or that hold NULL or non-finite components take no part, nor do rows with a
    NULL id; zero vectors do. Rows that share an id are one query (the one of smallest vector) and not
    candidates of each other. With fewer than k candidates all are returned; an empty table gives no rows.
    Scores are exact while they stay below 2^53.

    A large cell, or a large group of queries, is divided into blocks by a hash of the id, so a vector that
    makes up a third of all rows is spread over tasks.
    """
    spark = table.sparkSession
    ship(spark)
    rows = vectors(table).select(
        "vec_id", F.transform("vector", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("vector")
    )
    sample = [r["vector"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(PIVOT_SAMPLE).collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chosen = choose_pivots(np.array(sample), pivots).tolist()
    cells = materialise(rows.mapInPandas(partial(_assigned, pivots=chosen), _CELLS), "voronoi-cells")

    # The summaries: of each cell the distances of the k + 1 nearest ids, by their nearest row, and counts. Their
    # number depends on the parameters alone; k of them are of other ids than a query's.
    nearness = F.row_number().over(Window.partitionBy("cell").orderBy("distance", "vec_id"))
    near = (
        cells.groupBy("cell", "vec_id")
        .agg(F.min("distance").alias("distance"))
        .withColumn("n", nearness)
        .filter(F.col("n") <= k + 1)
    ).collect()
    of, nearest, owners = ([r[c] for r in near] for c in ("cell", "distance", "vec_id"))
    questions = cells.filter(is_query)
    least = (
        questions.mapInPandas(
            partial(_reach, pivots=chosen, cells=of, nearest=nearest, ids=owners, k=k),
            "group int, cell int, least double",
        )
        .groupBy("group", "cell")
        .agg(F.min("least").alias("least"))
    )
    bounds = spark.createDataFrame([tuple(r) for r in least.collect()], "group int, cell int, least double")
    needed = (
        cells.join(F.broadcast(bounds), "cell")  # at most pivots x pivots rows
        .filter(F.col("distance") >= F.col("least"))
        .select("group", "vec_id", "vector")
    )
    sizes = {r["group"]: r["n"] for r in needed.groupBy("group").agg(F.count("*").alias("n")).collect()}
    asked = {r["cell"]: r["n"] for r in questions.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    split = spark.createDataFrame(
        [(g, -(-n // BLOCK_ROWS), -(-asked[g] // BLOCK_QUERIES)) for g, n in sizes.items()],
        "group int, data_blocks int, query_blocks int",
    )
    split = F.broadcast(split)  # one row per pivot

    def block(count: str, seed: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    data = needed.join(split, "group").select(
        "group", "vec_id", "vector", block("data_blocks", 1).alias("d"), every("query_blocks").alias("q")
    )
    question_rows = (
        questions.groupBy("vec_id")
        .agg(F.min(F.struct("vector", "cell")).alias("row"))
        .select("vec_id", "row.vector", F.col("row.cell").alias("group"))
        .join(split, "group")
        .select(
            F.col("group").alias("query_group"),
            F.col("vec_id").alias("query_id"),
            F.col("vector").alias("query"),
            every("data_blocks").alias("query_d"),
            block("query_blocks", 2).alias("query_q"),
        )
    )
    found = (
        data.groupBy("group", "d", "q")
        .cogroup(question_rows.groupBy("query_group", "query_d", "query_q"))
        .applyInPandas(partial(_solve, k=k), PARTIAL)
    )
    return merged(found, k).withColumn("score", F.col("score").cast("long"))
