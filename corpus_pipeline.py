"""From raw documents to packed training windows, in four stages over the operators in ``tidemark.llm``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import near_copies, ordinal, packing, suffixes
from tidemark.llm.common import small_batches, table
from tidemark.session import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labels among the given documents."""
    small_batches(spark)
    return ordinal.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard similarity of at least 0.8.

    Fingerprints meet by SimHash balls first; the pairs that lie outside of every ball are found by a prefix filter. Of rows
    that share an id one stays; of rows with a NULL id one of each text stays.
    """
    small_batches(spark)
    return near_copies.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also start earlier are cut out of the texts; ``n_chars`` follows the text.

    Chunks and buckets are smaller than in a job of its own, since workers serve all stages; the result is the same.
    """
    small_batches(spark)
    cut = suffixes.without_repeats(docs, chunk_bytes=1 << 21, bucket_bytes=1 << 22)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of at most 2048 tokens: one row per piece, with its ids.

    Workers serve all stages, so each remembers fewer words than in a job that only packs, and those for one task.
    """
    small_batches(spark)
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(docs, vocabulary, with_ids=True, remembered=60_000, text_block=1 << 19, forget=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("packing", pack),
]

#: SQL cannot express the fitted classifier, the shingle sets or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again, so a lost executor costs one stage at most."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
