"""Approximate search with randomly rotated one-bit codes.

A vector is centred, normalised and rotated by a random orthogonal matrix; the signs are its code, packed
into bits. Two scalars correct the estimate: the length of the centred vector and the inner product of the
normalised vector with its own code. For a query the inner product is estimated from the code, with an error
bound that holds with high probability; only vectors whose upper bound reaches the k-th best score are
scored exactly.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship
from tidemark.llm.vectors import PARTIAL, best, matrix, merged, vectors
from tidemark.session import materialise

#: Half-width of the error bound in standard deviations of the estimate: about 3 codes in 100 lie beyond one side.
BOUND = 1.9
#: Vectors and queries that meet in one task.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096
_CODES = "vec_id long, vector array<double>, code binary, length double, fit double, middle double"


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, lengths of the centred vectors, and <vector, code> of the normalised ones.

    A vector at the centre has length 0 and fit 1: its estimate is exact.
    """
    dim = x.shape[1]
    rotated = (x - centre) @ rotation(dim, seed)
    length = np.linalg.norm(rotated, axis=1)
    fit = np.abs(rotated).sum(axis=1) / np.sqrt(dim) / np.where(length > 0, length, 1)
    return np.packbits(rotated > 0, axis=1), length, np.where(length > 0, fit, 1.0)


def estimate(
    codes: np.ndarray, length: np.ndarray, fit: np.ndarray, queries: np.ndarray, seed: int, bound: float
) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries with centred vectors, and the half-width of their bounds."""
    dim = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32)
    signs = (2 * signs - 1) / np.float32(np.sqrt(dim))
    rotated = (queries @ rotation(dim, seed)).astype(np.float32)
    scale = (length / fit).astype(np.float32)
    spread = bound * length * np.sqrt(np.maximum(0, 1 - fit**2)) / fit / np.sqrt(max(1, dim - 1))
    norms = np.linalg.norm(queries, axis=1)
    return (rotated @ signs.T) * scale, norms[:, None] * spread.astype(np.float32)


def _encoded(batches, centre: list[float], seed: int):
    for frame in batches:
        if len(frame):
            x, c = matrix(frame["vector"]), np.array(centre)
            codes, frame["length"], frame["fit"] = encode(x, c, seed)
            frame["code"] = [row.tobytes() for row in codes]
            frame["middle"] = x @ c
            yield frame[["vec_id", "vector", "code", "length", "fit", "middle"]]


def _search_block(_key, data: pd.DataFrame, asked: pd.DataFrame, k: int, seed: int, bound: float) -> pd.DataFrame:
    if not len(data) or not len(asked):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    x, ids = matrix(data["vector"]), data["vec_id"].to_numpy()
    codes = np.frombuffer(b"".join(data["code"]), np.uint8).reshape(len(data), -1)
    length, fit = data["length"].to_numpy(), data["fit"].to_numpy()
    queries, query_ids = matrix(asked["vector"]), asked["vec_id"].to_numpy()
    # <vector, query> = <vector - centre, query> + <centre, query>; the second is the same for all vectors.
    found: list[tuple[np.ndarray, ...]] = []
    for start in range(0, len(queries), 256):
        part = queries[start : start + 256]
        about, width = estimate(codes, length, fit, part, seed, bound)
        first = min(k + 1, len(ids))
        likely = np.argpartition(-about, first - 1, axis=1)[:, :first]
        for i, query in enumerate(part):
            query_id = query_ids[start + i]
            top = likely[i][ids[likely[i]] != query_id]
            # The k-th best score among the likeliest bounds the answer from below.
            need = np.partition((x[top] * query).sum(1), len(top) - k)[len(top) - k] if len(top) >= k else -np.inf
            centre = asked["middle"].iat[start + i]
            chance = about[i] + width[i] >= need - centre - 1e-5 * (1 + abs(need))
            chance[top] = True
            chance &= ids != query_id
            maybe = np.flatnonzero(chance)
            score = (x[maybe] * query).sum(1)
            chosen = best(score, ids[maybe], k)
            found.append((np.full(len(chosen), query_id), ids[maybe][chosen], score[chosen]))
    q, v, s = (np.concatenate(c) for c in zip(*found))
    return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})


def search(table: DataFrame, is_query: Column, k: int = 20, seed: int = 7, bound: float = BOUND) -> DataFrame:
    """The k vectors of largest inner product found for every query row: ``query_id, rank, vec_id, score``.

    ``table`` has ``vec_id`` and ``embedding``; ``is_query`` is a condition on ``vec_id``. Every row but the
    query's own is a candidate. Scores are exact inner products of the original vectors in double precision;
    ties go to the smaller id. Vectors that are NULL, empty, zero, not of the commonest length, or that hold
    NULL or non-finite components take no part, nor do rows with a NULL id. Rows that share an id are one
    query and not candidates of each other; equal rows of an id appear once each as candidates. With fewer
    than k candidates all are returned. An empty table gives no rows.

    Vectors and queries are dealt to blocks by a hash of the id and every pair of blocks is one task's work,
    so no group of equal vectors and no query set grows a task; the partial answers (k per query and block)
    are merged by query.
    """
    spark = table.sparkSession
    ship(spark)
    rows = vectors(table).filter(F.exists("vector", lambda x: x != 0))
    first = rows.first()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = len(first["vector"])
    centre = list(rows.agg(*[F.avg(F.get("vector", F.lit(i))).alias(f"c{i}") for i in range(dim)]).first())
    index = materialise(rows.mapInPandas(partial(_encoded, centre=centre, seed=seed), _CODES), "one-bit-index")
    n, asked = index.agg(F.count("*"), F.count_if(is_query)).first()
    blocks, question_blocks = -(-n // BLOCK_ROWS), max(1, -(-asked // BLOCK_QUERIES))
    b = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    q = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(question_blocks)).cast("int")
    data = index.select("*", b.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(question_blocks - 1))).alias("q"))
    questions = (
        index.filter(is_query)
        .dropDuplicates(["vec_id"])
        .select("vec_id", "vector", "middle", q.alias("q"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    )
    found = data.groupBy("b", "q").cogroup(questions.groupBy("b", "q")).applyInPandas(
        partial(_search_block, k=k, seed=seed, bound=bound), PARTIAL
    )
    return merged(found, k)
