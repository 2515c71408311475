"""The pipeline's near copies against brute force over five-word shingles."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest

from tidemark.llm import near_copies

SF = "/root/testdata/sf0.001"


def copies(seed=5, groups=60):
    """Texts of random words, copies with some words replaced, and one large group of copies with a common line."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(6))
    line = [word() for _ in range(12)]
    texts = []
    for g in range(groups):
        base = [word() for _ in range(rng.randint(20, 600))]
        texts.append(base + line)
        for _ in range(12 if g == 0 else 3):
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, int(len(copy) * rng.choice([0.005, 0.01, 0.02, 0.03])))):
                copy[at] = word()
            texts.append(copy + line if g % 2 else line + copy)
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def brute(rows):
    """Pairs of similarity 0.8 and above, and the least id of each component."""
    sets = {}
    for i, text in rows:
        words = (text or "").lower().split()
        sets[i] = {tuple(words[at : at + 5]) for at in range(max(1, len(words) - 4))} if words else set()
    pairs, root = [], {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b:
                both = len(sets[a] | sets[b])
                if not both or len(sets[a] & sets[b]) / both >= 0.8:
                    pairs.append((a, b))
                    low, high = sorted((find(a), find(b)))
                    root[high] = low
    return pairs, {i: find(i) for i in sets}


@pytest.mark.parametrize("sample", [4096, 1])
def test_every_near_copy_is_found(spark, monkeypatch, sample):
    monkeypatch.setattr(near_copies, "SAMPLE", sample)
    rows = copies()
    pairs, want = brute(rows)
    assert len(pairs) > 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == want


def test_the_stage_keeps_one_of_each(spark):
    rows = copies(8, 20) + [(900, None), (901, " \n"), (902, "two words"), (903, "Two  Words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = {r.doc_id for r in stage(spark, docs, SF).collect()}
    assert kept == set(brute(rows)[1].values())


def test_chains_and_large_groups_through_both_rounds(spark):
    # A window moves over a long line of words: neighbours are similar, ends are not, and all share one shingle.
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 120])) for i in range(60)]
    rows += [(100 + i, " ".join(["one", "line", "for", "all", "here"] + [f"x{i}y{k // 9}z{k % 9}" for k in range(20)])) for i in range(30)]
    rows += [(200 + i, " ".join(["one", "line", "for", "all", "here"] + [f"x{i}y{k // 9}z{k % 9}" for k in range(21)])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == brute(rows)[1]


def test_repeated_ids_and_a_clashing_column(spark):
    rows = [(1, "a b c d e f", "x"), (1, "g h i j k l m", "y"), (2, "a b c d e f", "z"), (None, "n", None), (None, "n", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row_of_id string")
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 1] and {r["_row_of_id"] for r in got if r["doc_id"]} <= {"x", "y"}


def test_a_bitmap_tells_long_texts_apart():
    """Sets of a thousand that share four members of ten: the folded bitmaps rule them out, and do not rule out copies."""
    rng = np.random.default_rng(5)
    members = np.unique(rng.integers(-(1 << 62), 1 << 62, 1600))
    one, other, copy = members[:1000], members[600:], np.concatenate([members[:950], members[1000:1050]])

    def passes(a, b):
        words = (np.array(near_copies._folded(near_copies._parity(x)), np.int64) for x in (a, b))
        differ = int(np.bitwise_count(next(words) ^ next(words)).sum())
        return (near_copies.SIMILAR + near_copies.OF) * differ <= (near_copies.OF - near_copies.SIMILAR) * (len(a) + len(b))

    assert passes(one, copy) and not passes(one, other)
