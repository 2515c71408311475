"""Folders of stored tables, through the file system that Spark itself uses for the path.

The only place that reaches into the JVM; PySpark has no call of its own for it.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import SparkSession


def _hadoop_path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def store_exists(spark: SparkSession, path: str) -> bool:
    files, target = _hadoop_path(spark, path)
    return files.exists(target)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether the table's last write came to its end: Spark puts its mark there when all files are in place."""
    return store_exists(spark, f"{path}/_SUCCESS")


def partitions_of(spark: SparkSession, path: str, names: Sequence[str]) -> list[tuple[str, ...]]:
    """Values of the nested partition folders ``name=value`` of a table, from listing folders; no file is opened.

    A folder without any visible file is none.
    """
    found: list[tuple[str, ...]] = []
    files, root = _hadoop_path(spark, path)

    def visit(folder, values: tuple[str, ...]) -> None:
        entries = list(files.listStatus(folder))
        if len(values) == len(names):
            if any(e.isFile() and e.getPath().getName()[0] not in "._" for e in entries):
                found.append(values)
            return
        for e in entries:
            name, _, value = e.getPath().getName().partition("=")
            if e.isDirectory() and name == names[len(values)]:
                visit(e.getPath(), (*values, unquote(value)))

    if files.exists(root):
        visit(root, ())
    return found


def delete_folder(spark: SparkSession, path: str) -> None:
    files, target = _hadoop_path(spark, path)
    files.delete(target, True)
