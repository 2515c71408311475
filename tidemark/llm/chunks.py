"""Documents in chunks of a few MB, and packed columns that travel between chunks and buckets.

A chunk is one row with the texts of many documents, written once as a bucketed table: later steps join
replies to chunks without moving the texts again, and are the same after a lost executor. Numeric columns
travel as compressed arrays, a few bytes per value.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship
from tidemark.session import scratch_path

CHUNK_BYTES = 1 << 22
_SCHEMA = "chunk long, body binary, sizes binary, rows binary"


#: Blocks above this many bytes are compressed; the many short ones of a very large corpus are not worth it.
_COMPRESSED = 512


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of equal length and any number types as one block; whole numbers are stored as differences."""
    parts = [f"{len(columns[0])} {' '.join(c.dtype.str for c in columns)}\n".encode()]
    for c in columns:
        parts.append((np.diff(c, prepend=c.dtype.type(0)) if c.dtype.kind == "i" else c).tobytes())
    block = b"".join(parts)
    return b"Z" + zstandard.compress(block, 3) if len(block) > _COMPRESSED else b"R" + block


def unpack(block: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(block[1:]) if block[:1] == b"Z" else block[1:]
    at = data.index(b"\n") + 1
    n, *types = data[:at].decode().split()
    out = []
    for kind in types:
        c = np.frombuffer(data, kind, int(n), at)
        at += c.nbytes
        out.append(np.cumsum(c, dtype=c.dtype) if c.dtype.kind == "i" else c)
    return out


def batch_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_batch(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as reader:
        return reader.read_next_batch()


def _cut(batches: Iterator[pa.RecordBatch], text_at: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 32
    made = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch.set_column(text_at, batch.schema.field(text_at), batch.column(text_at).fill_null(""))
        sizes = pc.binary_length(batch.column(text_at)).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // chunk_bytes
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(edges, edges[1:]):
            part = batch.slice(start, stop - start)
            body = b"".join(part.column(text_at).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([first + made], pa.int64()),
                    "body": pa.array([zstandard.compress(body, 3)], pa.binary()),
                    "sizes": pa.array([sizes[start:stop].tobytes()], pa.binary()),
                    "rows": pa.array(
                        [zstandard.compress(batch_bytes(part.remove_column(text_at)), 3)], pa.binary()
                    ),
                }
            )
            made += 1


def chunked(rows: DataFrame, total_bytes: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``chunk, body, sizes, rows``: texts of column ``text`` joined, their byte sizes, the other columns.

    Stored in the shared folder, bucketed by ``chunk``. A text longer than a chunk has one of its own.
    """
    spark = rows.sparkSession
    ship(spark)
    buckets = max(12, min(1 << 14, total_bytes // (3 * chunk_bytes)))
    name = f"chunks_{uuid.uuid4().hex}"
    (
        rows.mapInArrow(partial(_cut, text_at=rows.columns.index("text"), chunk_bytes=chunk_bytes), _SCHEMA)
        .write.bucketBy(int(buckets), "chunk")
        .option("path", scratch_path(spark, "chunks"))
        .option("compression", "none")  # the blocks are compressed already
        .saveAsTable(name)
    )
    table = spark.table(name).select("chunk", "body", "sizes", "rows")
    return table


def contents(row) -> tuple[np.ndarray, np.ndarray, pa.RecordBatch]:
    """Bytes of the joined texts, sizes of the texts, and the other columns."""
    data = np.frombuffer(zstandard.decompress(row["body"], max_output_size=1 << 31) if row["body"] else b"", np.uint8)
    return data, np.frombuffer(row["sizes"], np.int64), read_batch(zstandard.decompress(row["rows"]))
