"""Sharded documents arrive whole, and can be read from the files of their shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import sharding


def test_documents_move_with_all_columns(spark, edge_docs, edge_rows, plan_of):
    moved = sharding.move_documents(edge_docs, shards=5)
    assert sorted(map(repr, (tuple(r["document"]) for r in moved.collect()))) == sorted(map(repr, edge_rows))
    slots = moved.groupBy("shard").agg(F.min("slot").alias("low"), F.max("slot").alias("high"), F.count("*").alias("n")).collect()
    assert all(r["low"] == 0 and r["high"] == r["n"] - 1 for r in slots)
    plan = plan_of(sharding.shard_documents(edge_docs, shards=5))
    assert "Python" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_runs_of_a_shard(spark, edge_docs):
    one, several = sharding.shard_documents(edge_docs, shards=3), sharding.shard_documents(edge_docs, shards=3, run_bytes=1 << 13)
    counts = {r["shard"]: r["n"] for r in several.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) == one.count()
    for r in several.groupBy("shard").agg(F.count_distinct("slot").alias("n"), F.max("slot").alias("high")).collect():
        assert r["n"] == counts[r["shard"]] == r["high"] + 1


def test_written_shards(spark, edge_docs, tmp_path):
    clash = edge_docs.withColumn("slot", F.lit("other"))
    sharding.write_shards(clash, f"{tmp_path}/shards", shards=4)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert set(back.columns) == set(edge_docs.columns) | {"shard", "slot"} and back.count() == edge_docs.count()
    assert dict(back.dtypes)["slot"] == "bigint"


def test_no_documents(spark, no_docs):
    assert sharding.move_documents(no_docs).count() == 0 and sharding.shard_documents(no_docs).count() == 0
