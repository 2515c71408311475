"""A short string in very many places, with other surroundings each time, is spread over tasks; results do not change."""

from __future__ import annotations

import random
from collections import Counter

from test_text_operators import brute_repeats

from tidemark.llm import suffixes
from tidemark.llm.chunks import unpack


def rows_with_a_footer():
    rng = random.Random(4)
    footer = " <<all rights reserved by the owners of this small corpus, printed here>> "
    own = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    rows = [(i, own(150) + footer + own(150)) for i in range(300)]
    # Copies of some surroundings, whole and in part.
    rows += [(300 + i, own(40) + rows[i][1][60:320] + own(40)) for i in range(0, 60, 2)]
    return rows


def test_a_common_gram_is_spread_and_results_stay(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_GRAM", 8)
    rows = rows_with_a_footer()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffixes.repeated_passages(docs, chunk_bytes=6000).collect()
    assert Counter(tuple(r) for r in got) == brute_repeats(rows, 100)


def test_no_bucket_holds_all_suffixes_of_a_common_gram(spark, monkeypatch):
    rng = random.Random(9)
    own = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    docs = spark.createDataFrame(
        [(i, own(34) + "=" * 32 + own(34)) for i in range(2000)], "doc_id long, text string"
    ).repartition(3)

    monkeypatch.setattr(suffixes, "HOT_GRAM", 20)
    _, answers, _ = suffixes._sorted_passes(docs, 100, 32, 20_000)
    sizes = Counter()
    for r in answers.filter("step = 0").collect():
        sizes[r.bucket] += len(unpack(r.packed)[0])
    assert sum(sizes.values()) >= 2000
    # A gram that the place of least hash favours in many texts; without spreading its bucket holds them all.
    assert max(sizes.values()) < 2 * sum(sizes.values()) / 12
