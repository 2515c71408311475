"""The pipeline's stages on a small corpus."""

from __future__ import annotations

import corpus_pipeline
import pytest

from tidemark.llm import packing

SF = "/root/testdata/sf0.001"


def test_stages_pass_on_all_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        rows = [r.doc_id for r in docs.collect()]
        assert len(rows) == len(set(rows)) and 0 < len(rows) <= before
        before = len(rows)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.agg({"length": "max"}).first()[0] <= packing.CAPACITY
    assert last.select("doc_id").distinct().count() == before


def test_stages_survive_odd_documents(spark, edge_docs, edge_rows, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0, name
        assert stage(spark, edge_docs, SF).count() > 0, name


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_names_are_short(name):
    assert len(name) <= 40
