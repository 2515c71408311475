"""From landed ranking pages to the accepted and skipped lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.classify import accepted, classify, run_counters, skipped
from tidemark.params import DEFAULT_RULES, RANKING_QUOTE, UNIVERSE_SIZE, RuleSet
from tidemark.sources.lists import write_entities, write_skipped
from tidemark.sources.payloads import ranked_entities, read_ranking_pages


def refresh_universe(
    spark: SparkSession,
    landing: str,
    accepted_path: str,
    skipped_path: str,
    n: int = UNIVERSE_SIZE,
    quote: str = RANKING_QUOTE,
    rules: RuleSet = DEFAULT_RULES,
) -> DataFrame:
    """Rank, classify, write both lists; returns the counters of the run (one row)."""
    entities = classify(ranked_entities(read_ranking_pages(spark, landing), n, quote), rules)
    kept = accepted(entities)
    # Position in the accepted list: at most n rows are left at this point.
    write_entities(
        kept.withColumn("position", F.expr("row_number() over (order by market_cap_rank)").cast("long")),
        accepted_path,
    )
    write_skipped(skipped(entities), skipped_path)
    return run_counters(entities)
