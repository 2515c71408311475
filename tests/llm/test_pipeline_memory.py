"""What the pipeline's stages hold outside of the heap: batches sent to Python workers, and those that come back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline
from tidemark.llm import packing
from tidemark.llm.common import BATCH_BYTES

_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("stage", [stage for _, stage in corpus_pipeline.STAGES])
def test_batches_of_every_stage_are_small(spark, tmp_path, stage):
    spark.range(50).selectExpr("id AS doc_id", "0 AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 700) AS text")
    before = spark.conf.get(_LIMIT)

    def sizes_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [batch.nbytes]})

    try:
        stage(spark, docs.limit(50), str(tmp_path))
        sizes = [r.size for r in docs.mapInArrow(sizes_of, "size long").collect()]
    finally:
        spark.conf.set(_LIMIT, before)
    assert sum(sizes) > 4 * BATCH_BYTES and max(sizes) <= 2 * BATCH_BYTES


def test_tokens_are_handed_over_before_they_pile_up():
    packer = packing._Packer(0, 2048, 512, with_ids=True)
    ids = np.zeros(2048 * 16, "<u4").tobytes()
    most = held = 0
    for doc_id in range(40):
        packer.add(doc_id, ids)
        held = sum(len(r[-1]) for r in packer.rows)
        most = max(most, held)
        if packer.full():
            assert packer.take().num_rows
    assert most < packing.OUTPUT_TOKENS + len(ids) // 4
