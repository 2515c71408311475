"""Labels of documents that are not given take no part in the toxicity model."""

from __future__ import annotations

from tidemark.llm import ordinal


def test_labels_without_a_given_document_change_nothing(spark):
    rows = [(i, "you vile idiot go away" if i % 4 == 0 else f"a calm text about river {i} and stone") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    own = [(i, int(i % 4 == 0)) for i in range(80)]
    others = [(1000 + i, i % 2) for i in range(4000)]
    labels = spark.createDataFrame(own + others, "doc_id long, toxic int")
    mine = labels.filter("doc_id < 1000")
    model = ordinal.train(docs, labels, sample=100)
    assert model == ordinal.train(docs, mine, sample=100)
    assert model.weights
