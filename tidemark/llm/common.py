"""Reading tables and shipping this package to Python workers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED = "_tidemark_package_shipped"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, as ``--py-files`` would; once per context.

    The driver serves the archive to the executors itself, so it needs no shared folder.
    """
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "tidemark_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    setattr(context, _SHIPPED, True)


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` (NULL read as empty); every other column is left behind, whatever its name."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def input_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts; one number."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


#: Text that is turned into Python objects at a time.
SLICE_BYTES = 1 << 22

#: Bytes of rows sent to a Python worker at a time, where several stages share their workers.
BATCH_BYTES = 1 << 21


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of about BATCH_BYTES, from now on in this session; a longer row goes alone.

    Spark's own limits are 10000 rows and 64 MB. Both sides of the pipe hold a batch outside of the JVM's heap, and its buffers
    grow by doubling. Results do not depend on the size.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_text_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Lists of ids and texts of a few MB; a longer text comes alone."""
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes) - sizes) // SLICE_BYTES
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(ids)]
        for start, stop in zip(edges, edges[1:]):
            yield ids.slice(start, stop - start).to_pylist(), texts.slice(start, stop - start).to_pylist()


def text_slices(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a few MB of text each; a longer text comes alone."""
    sizes = pc.binary_length(batch.column(text_at)).fill_null(0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for start, stop in zip(edges, edges[1:]):
        yield batch.slice(start, stop - start)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: the worker is used again, by other stages too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library; it keeps what was freed
        pass
