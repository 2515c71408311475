"""Embedding whitening: leading principal components by a block Jacobi-Davidson method, and every vector on their scale.

The covariance is never formed. It is applied to a block of directions by one pass over the vectors, each centred before it
is multiplied. Directions live on the driver: their number does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship
from tidemark.llm.vectors import usable
from tidemark.session import materialise

COMPONENTS, SEED = 32, 7
#: Vectors become whole numbers: floor(STEPS * entry) + OFFSET.
STEPS, OFFSET = 64, 1_000_000
#: An entry whose whole number is at least this large cannot be held beside the others.
MOST = 1 << 40
#: Vectors in a block, partial sums that meet in one task, directions beyond the wanted ones.
BLOCK_ROWS, FAN_IN, GUARD = 4096, 64, 8
#: Outer rounds, and steps of one inner solution.
MAX_ROUNDS, MAX_STEPS = 60, 12
_EPS = float(np.finfo(float).eps)

_BLOCKS = "ids array<long>, kind string, x binary"
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_ARROW = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64())]
    + [("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]
)

Multiply = Callable[[np.ndarray], np.ndarray]

# ---- eigenvectors ---------------------------------------------------------------------------------------------------


def minres(multiply: Multiply, shifts: np.ndarray, project: Multiply, right: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """Approximate solutions of P (A - shift) P t = right, a column for each shift; every step multiplies all columns at once.

    A column that has come to ``enough`` of its first residual, or whose Krylov space ends, no longer moves.
    """
    norm = np.linalg.norm(right, axis=0)
    v, before = right / np.where(norm > 0, norm, 1), np.zeros_like(right)
    found, w, w_old = (np.zeros_like(right) for _ in range(3))
    c = c_old = np.ones(len(norm))
    s = s_old = beta = np.zeros(len(norm))
    eta = norm.copy()
    live = norm > 0
    for _ in range(steps):
        if not live.any():
            break
        moved = project(multiply(v) - v * shifts)
        alpha = (v * moved).sum(0)
        following = moved - v * alpha - before * beta
        beta_next = np.linalg.norm(following, axis=0)
        third, turned = s_old * beta, c_old * beta
        second, first = c * turned + s * alpha, c * alpha - s * turned
        length = np.hypot(first, beta_next)
        live &= length > 0
        length = np.where(length > 0, length, 1)
        c_old, s_old, c, s = c, s, first / length, beta_next / length
        w_old, w = w, (v - w * second - w_old * third) / length
        found += np.where(live, c * eta, 0) * w
        eta = -s * eta
        live &= (np.abs(eta) > enough * norm) & (beta_next > _EPS * np.abs(alpha))
        before, beta, v = v, beta_next, following / np.where(beta_next > 0, beta_next, 1)
    return found


def _orthonormal(columns: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Orthonormal columns spanning what ``columns`` have outside ``against`` (which are orthonormal)."""
    size = np.linalg.norm(columns, axis=0)
    columns = columns[:, size > 0] / size[size > 0]
    for least in (1e-10, 0.5):  # the second time only rounding is left to remove
        for other in against:
            columns = columns - other @ (other.T @ columns)
        if not columns.shape[1]:
            return columns
        left, kept, _ = np.linalg.svd(columns, full_matrices=False)
        columns = left[:, kept > least]
    return columns


def jacobi_davidson(multiply: Multiply, dim: int, wanted: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues, falling, and their unit eigenvectors, of a symmetric positive operator.

    Rayleigh-Ritz on a growing search space; for every pair that is not done the correction equation, projected away from
    the finished and the present vectors, is solved roughly by MINRES and its solutions enlarge the space. Leading pairs
    are locked when their residual is at the rounding of one product. Raises where that is not reached in MAX_ROUNDS.
    """
    wanted = min(wanted, dim)
    room = 3 * wanted + 4 * GUARD
    tolerance = 8 * _EPS * max(8.0, np.sqrt(dim))
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, min(dim, wanted + GUARD))))[0]
    image = multiply(basis)
    locked, values, scale = np.zeros((dim, 0)), np.zeros(0), 0.0
    for outer in range(MAX_ROUNDS):
        small = basis.T @ image
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        scale = max(scale, float(ritz.max(initial=0.0)))
        residual = image - basis * ritz
        done = np.linalg.norm(residual, axis=0) <= tolerance * scale
        ready = min(int(np.argmin(done)) if not done.all() else len(done), wanted - len(values))
        locked, values = np.hstack([locked, basis[:, :ready]]), np.append(values, ritz[:ready])
        if len(values) == wanted:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        basis, image, ritz, residual = basis[:, ready:], image[:, ready:], ritz[ready:], residual[:, ready:]
        active = min(wanted - len(values), basis.shape[1])
        if basis.shape[1] + active > room:  # start again from the best part of the search space
            kept = active + GUARD
            basis, image = basis[:, :kept], image[:, :kept]
        known = np.hstack([locked, basis[:, :active]])

        def project(columns: np.ndarray, known: np.ndarray = known) -> np.ndarray:
            return columns - known @ (known.T @ columns)

        missing = np.flatnonzero(~done[ready : ready + active])
        steps = min(MAX_STEPS, outer + 1)
        t = minres(multiply, ritz[missing], project, project(-residual[:, missing]), steps, 0.5 ** (outer + 1))
        fresh = _orthonormal(t, locked, basis)
        if not fresh.shape[1]:
            outside = _orthonormal(np.random.default_rng(seed + outer + 1).normal(size=(dim, active)), locked, basis)
            if not outside.shape[1]:
                raise RuntimeError(f"residuals stay at {np.linalg.norm(residual[:, :active], axis=0).max() / scale:.1e} of the operator")
            fresh = outside
        basis, image = np.hstack([basis, fresh]), np.hstack([image, multiply(fresh)])
    raise RuntimeError(f"only {len(values)} of {wanted} eigenpairs after {MAX_ROUNDS} rounds")


# ---- passes over the vectors ----------------------------------------------------------------------------------------


def _pack(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            entries = part.column("vector").flatten().to_numpy(zero_copy_only=False)
            x = np.floor(STEPS * entries).astype(np.int64)
            most = int(np.abs(x).max(initial=0))
            kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([kind]),
                    pa.array([x.astype(kind).tobytes()], pa.binary()),
                ],
                ["ids", "kind", "x"],
            )


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Scalar, np.ndarray]]:
    for batch in batches:
        for ids, kind, x in zip(batch.column("ids"), batch.column("kind").to_pylist(), batch.column("x")):
            yield ids, np.frombuffer(x.as_py(), kind).reshape(-1, dim).astype(np.int64)


def _row(sums: np.ndarray) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["part", "sums"])


def _count(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Sums of the upper and of the lower 20 bits of every dimension, and the number of vectors."""
    sums = np.zeros(2 * dim + 1, np.int64)
    for _, x in _matrices(batches, dim):
        sums += np.concatenate([(x >> 20).sum(0), (x & 0xFFFFF).sum(0), [len(x)]])
    yield _row(sums)


def _multiply(batches: Iterator[pa.RecordBatch], dim: int, mean: np.ndarray, columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The sum of (x - mean) (x - mean)' columns, and one more row with the sum of squared lengths."""
    sums = np.zeros((dim + 1, columns.shape[1]))
    for _, x in _matrices(batches, dim):
        centred = x - mean
        sums[:dim] += centred.T @ (centred @ columns)
        sums[dim] += (centred * centred).sum()
    yield _row(sums)


def _squares(batches: Iterator[pa.RecordBatch], dim: int, mean: np.ndarray, map_: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of whitened vectors and of their products."""
    k = map_.shape[1]
    sums = np.zeros((k + 1, k))
    for _, x in _matrices(batches, dim):
        y = (x - mean) @ map_
        sums[:k] += y.T @ y
        sums[k] += y.sum(0)
    yield _row(sums)


def _add(frame: pd.DataFrame, kind: str) -> pd.DataFrame:
    total = sum(np.frombuffer(s, kind) for s in frame.sort_values("part")["sums"])
    return pd.DataFrame({"part": [int(frame["part"].min())], "sums": [total.tobytes()]})


def _total(blocks: DataFrame, sums: Callable, kind: str) -> np.ndarray:
    """Per-task sums added up: in groups of FAN_IN on executors until so few are left, the rest on the driver."""
    parts = blocks.mapInArrow(sums, "part long, sums binary")
    tasks = blocks.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        parts = parts.groupBy(F.pmod("part", F.lit(tasks))).applyInPandas(partial(_add, kind=kind), "part long, sums binary")
    rows = sorted((r["part"], bytes(r["sums"])) for r in parts.collect())
    return sum((np.frombuffer(s, kind) for _, s in rows[1:]), np.frombuffer(rows[0][1], kind).copy())


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Exact sums of (n x - S)^2; an error where they do not fit."""
    most = float(np.abs(n * x.astype(float) - sums.astype(float)).max(initial=0))
    if x.shape[1] * most * most >= 2.0**62 or n * float(np.abs(x).max(initial=0)) >= 2.0**62:
        exact = ((n * x.astype(object) - sums) ** 2).sum(1)
        if len(exact) and max(exact) >= 1 << 63:
            raise OverflowError("a deviation does not fit 64 bits")
        return exact.astype(np.int64)
    centred = n * x - sums.astype(np.int64)
    return (centred * centred).sum(1)


def _whiten(
    batches: Iterator[pa.RecordBatch], dim: int, n: int, sums: np.ndarray, mean: np.ndarray, map_: np.ndarray, explained: np.ndarray, error: float
) -> Iterator[pa.RecordBatch]:
    k = map_.shape[1]
    for ids, x in _matrices(batches, dim):
        rows = len(x)
        y = (x - mean) @ map_
        vec_id = ids.values.take(pa.array(np.repeat(np.arange(rows), k)))
        columns = (np.tile(np.arange(1, k + 1), rows), np.full(rows * k, n), np.repeat(_deviation(x, n, sums), k), y.ravel())
        columns += (np.tile(explained, rows), np.full(rows * k, error))
        arrays = [vec_id, *[pa.array(c).cast(f.type) for c, f in zip(columns, list(_ARROW)[1:])]]
        yield pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def _remaining(table: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id, vector`` of the rows that take part, and the length of their vectors."""
    vector: Column = F.col("vector")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter(usable(vector)).filter(F.forall("vector", lambda c: F.abs(c) < MOST / STEPS))
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = common["n"] if common else 0
    return rows.filter(F.size("vector") == dim), dim


def whiten(table: DataFrame, components: int = COMPONENTS, seed: int = SEED) -> DataFrame:
    """Every vector on the leading components: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    ``table`` has ``vec_id`` and ``embedding``; other columns are left behind. Vectors that are NULL or empty, that hold
    NULL, non-finite or huge entries (of MOST / STEPS and beyond), or that are not of the commonest length (ties: the
    shorter) take no part. All others are the fit list; ids may be NULL or repeat, and equal vectors count each. A
    component whose eigenvalue is zero but for rounding has no scale and is left out, so equal vectors or a single one
    give no rows, as does an empty table.

    Each product is one pass over the blocks of whole numbers in the shared folder and brings one small matrix to the
    driver, whatever the number of tasks. ``identity_error`` is measured on the whitened vectors themselves.
    """
    spark = table.sparkSession
    ship(spark)
    rows, dim = _remaining(table)
    if not dim:
        return spark.createDataFrame([], SCHEMA)
    blocks = materialise(rows.mapInArrow(partial(_pack, dim=dim), _BLOCKS), "vector-blocks")
    counted = _total(blocks, partial(_count, dim=dim), "<i8")
    n = int(counted[-1])
    # Sums of x - OFFSET; n x - S and x - S / n are the same for both. Python's numbers do not overflow.
    sums = np.array([(int(high) << 20) + int(low) for high, low in zip(counted[:dim], counted[dim:])], object)
    mean = np.array([float(s) for s in sums]) / n
    trace = 0.0

    def multiply(columns: np.ndarray) -> np.ndarray:
        nonlocal trace
        product = _total(blocks, partial(_multiply, dim=dim, mean=mean, columns=columns), "<f8").reshape(dim + 1, -1) / n
        trace = float(product[dim, 0])
        return product[:dim]

    values, vectors = jacobi_davidson(multiply, dim, components, seed)
    real = values > dim * _EPS * max(values[0], 0.0)
    values, map_ = values[real], vectors[:, real] / np.sqrt(values[real])
    if not len(values):
        return spark.createDataFrame([], SCHEMA)
    k = len(values)
    seen = _total(blocks, partial(_squares, dim=dim, mean=mean, map_=map_), "<f8").reshape(k + 1, k) / n
    error = float(np.abs(seen[:k] - np.outer(seen[k], seen[k]) - np.eye(k)).max())
    options = {"n": n, "sums": sums, "mean": mean, "map_": map_, "explained": values / trace, "error": error}
    return blocks.mapInArrow(partial(_whiten, dim=dim, **options), SCHEMA)
