"""The registered queries over the supplied tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat_format, katz, licences, one_bit, ordinal, packing, periodic, sharding, simhash, suffixes, voronoi, whitening
from tidemark.llm.common import table


def op1_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_bit.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op4_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal.score_toxicity(docs, ordinal.train(docs, table(spark, sf_dir, "labels")))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op7_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_voronoi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.knn_join(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op10_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document by checksum of its id repeats a stretch of its own words to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, g = F.size(words), F.floor(h / 10)
    docs = docs.select("doc_id", "text", words.alias("words"), n.alias("n"), g.alias("g"), ((h % 10 == 0) & (n > 0)).alias("planted"))
    a = F.pmod("g", "n").cast("int")
    p = (F.lit(1) + F.floor((F.col("n") - a) / (F.lit(3) + F.col("g") % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((F.col("n") - a) / p).cast("int")))
    planted = F.concat(F.slice("words", 1, a), F.slice(again, 1, F.col("n") - a))
    return docs.select("doc_id", F.when(F.col("planted"), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_with_planted_runs(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = [F.col(f"strongest.{c}").alias(c) for c in ("start", "length", "period")]
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *best,
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one more whose texts hold the template's own control strings."""
    said = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.conversation_digests(rows.unionByName(planted))


QUERIES = {
    f.__name__: f
    for f in (
        op1_one_bit_codes,
        op2_differencing_packing,
        op3_suffix_dedup,
        op4_simhash_balls,
        op5_ordinal_toxicity,
        op6_byte_bpe,
        op7_histogram_sort,
        op8_voronoi_join,
        op9_licence_scan,
        op10_katz_scores,
        op11_periodic_runs,
        op12_embedding_whitening,
        op13_chat_template,
    )
}

#: The other operators hash, fit, tokenise, approximate or sum logarithms; they are tested against brute force.
ORACLES: dict[str, str] = {
    "op8_voronoi_join": """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS w FROM embeddings
      WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
    "op13_chat_template": r"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
      UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    e AS (
      SELECT *, unnest([role, text]) AS part FROM c),
    f AS (
      SELECT conv_id, CAST(sum(length(part) + length(part) - length(replace(part, '\', ''))
        + (length(part) - length(replace(part, ':' || chr(10), ''))) // 2
        + (length(part) - length(replace(part, '</turn>', ''))) // 7
        + coalesce(list_sum(list_transform(regexp_extract_all(part, '#{3,}'), lambda r: length(r) - 2)), 0)
        + 7) AS BIGINT) AS formatted_chars
      FROM e GROUP BY conv_id)
    SELECT c.conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      first(f.formatted_chars) AS formatted_chars
    FROM c JOIN f ON c.conv_id IS NOT DISTINCT FROM f.conv_id GROUP BY c.conv_id""",
}
