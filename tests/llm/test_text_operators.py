"""Operators on documents against brute-force versions, with NULLs, ties, repeated rows and empty tables."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, katz, licences, ordinal, packing, sharding, simhash, suffixes

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def texts_of(rows):
    return [(r[0], r[1] or "") for r in rows]


# --- packing ---------------------------------------------------------------------------------------------------


def test_packing_places_every_token_once(spark, edge_docs, edge_rows, no_docs):
    got = packing.pack_documents(edge_docs, WORDS, with_ids=True).toPandas()
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    want = Counter()
    for doc_id, text in texts_of(edge_rows):
        want[doc_id, tuple([*tokenizer.encode(text, add_special_tokens=False).ids, 1])] += 1
    pieces = defaultdict(list)
    for r in got.itertuples():
        pieces[None if r.doc_id != r.doc_id else int(r.doc_id)].append((r.start, r.length, list(r.ids), r.doc_tokens))
    for doc_id in {d for d, _ in want}:
        expected = Counter()
        for (d, ids), n in want.items():
            if d == doc_id:
                for token in enumerate(ids):
                    expected[token] += n
        found = Counter((s + k, t) for s, n, ids, _ in pieces[doc_id] for k, t in enumerate(ids) if len(ids) == n)
        assert found == expected
    for r in got.itertuples():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for _, window in got.groupby("sequence_id"):
        window = window.sort_values("offset")
        assert (window.offset == window.length.cumsum() - window.length).all()
        assert window.length.sum() <= 2048
    assert packing.pack_documents(no_docs, WORDS).count() == 0


def test_differencing_fills_windows_evenly():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 512, 600).tolist()
    windows = packing.fill(sizes, 2048)
    loads = np.bincount(windows, sizes)
    assert loads.max() <= 2048 and loads.max() - loads.min() <= 60
    assert len(loads) <= -(-sum(sizes) // 2048) + 2
    # Two-way differencing of the textbook: 8 7 6 5 4 ends at a difference of 2.
    two = np.bincount(packing.difference([8, 7, 6, 5, 4], 2), [8, 7, 6, 5, 4])
    assert abs(two[0] - two[1]) == 2
    # Three items of 3 do not fit two windows of 4: the count rises to three.
    assert sorted(packing.fill([3, 3, 2], 4).tolist()) == [0, 1, 2]
    assert packing.fill([]).tolist() == []


# --- suffixes --------------------------------------------------------------------------------------------------


def brute_repeats(rows, length):
    """As the contract: rows of one id are versions of one document."""
    first: dict[bytes, tuple] = {}
    datas = [((-math.inf if i is None else i), t.encode()) for i, t in texts_of(rows)]
    for i, data in datas:
        for s in range(len(data) - length + 1):
            key = (i, s)
            first[data[s : s + length]] = min(first.get(data[s : s + length], key), key)
    out = Counter()
    for i, data in datas:
        covered = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - length + 1):
            if first[data[s : s + length]] < (i, s):
                covered[s : s + length] = True
        covered = covered[:-1]
        spans = int((covered[1:] & ~covered[:-1]).sum() + covered[0]) if len(data) else 0
        kept = bytes(np.frombuffer(data, np.uint8)[~covered])
        out[None if i == -math.inf else i, len(data), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("chunk_bytes", [700, 1 << 22])
def test_repeated_passages(spark, edge_docs, edge_rows, no_docs, chunk_bytes):
    got = suffixes.repeated_passages(edge_docs, chunk_bytes=chunk_bytes).collect()
    assert Counter(tuple(r) for r in got) == brute_repeats(edge_rows, 100)
    assert suffixes.repeated_passages(no_docs).count() == 0


def test_hot_passages_are_spread_and_still_found(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_SUFFIXES", 2)
    shared = "the passage that every document of this small corpus holds in the same words, long enough to count as one"
    rows = [(i, f"{i * 7919} own words {i} {shared} and an ending {i * 31}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.repeated_passages(docs, chunk_bytes=400).collect()
    assert Counter(tuple(r) for r in got) == brute_repeats(rows, 100)


def test_cut_texts_stay_valid(spark, edge_docs, edge_rows):
    cut = suffixes.without_repeats(edge_docs)
    assert cut.columns == edge_docs.columns and cut.dtypes == edge_docs.dtypes
    assert cut.count() == len(edge_rows)
    texts = {r.doc_id: r.text for r in cut.filter("doc_id in (1, 2, 12, 30, 100)").collect()}
    assert texts[2] == "" and texts[1] == edge_rows[0][1] and texts[12] == ""


# --- SimHash ---------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=4):
    names = sorted(set(values))
    root = {v: v for v in names}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in names}


def test_near_duplicates(spark, edge_docs, edge_rows, no_docs):
    prints = [(i, brute_fingerprint(t)) for i, t in texts_of(edge_rows)]
    root = brute_components([p for _, p in prints])
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(least.get(root[p], i), i)
    want = Counter((i, f"{p:016x}", least.get(root[p])) for i, p in prints)
    assert Counter(tuple(r) for r in simhash.near_duplicates(edge_docs).collect()) == want
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("prefix_rows", [1 << 16, 50])
def test_links_within_the_radius_are_all_found(spark, monkeypatch, prefix_rows):
    monkeypatch.setattr(simhash, "PREFIX_ROWS", prefix_rows)
    monkeypatch.setattr(simhash, "VARIANTS", 1 << 16)
    rng = np.random.default_rng(5)
    values = []
    for centre in rng.integers(0, 2**63, 60, dtype=np.uint64):
        for flips in (0, 2, 4, 5, 6):
            values.append(int(centre) ^ sum(1 << int(b) for b in rng.choice(64, flips, replace=False)))
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    found = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in set(signed)], "value long"))
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in found.collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in links)
    root = brute_components(values)
    mine = {v: v for v in values}

    def find(v):
        while mine[v] != v:
            v = mine[v]
        return v

    for a, b in links:
        assert root[a] == root[b]
        x, y = sorted((find(a), find(b)))
        mine[y] = x
    assert all((root[a] == root[b]) == (find(a) == find(b)) for a in values for b in values)


def test_one_document_of_each_group_stays(spark, edge_docs, edge_rows):
    kept = simhash.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.filter("doc_id is not null").collect()]
    groups = simhash.near_duplicates(edge_docs.filter("doc_id is not null")).collect()
    assert sorted(ids) == sorted({r.component_id for r in groups})


# --- toxicity --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic_tables(spark):
    import random

    rng = random.Random(11)
    plain = ["river", "stone", "table", "winter", "garden", "paper", "music", "window", "bread", "cloud"]
    bad = ["blarg", "snorf", "grunk", "vlim"]
    docs, labels = [], []
    for i in range(600):
        words = rng.choices(plain, k=rng.randint(5, 60))
        toxic = i % 4 == 0
        if toxic:
            for w in rng.sample(bad, rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), w)
        docs.append((i, " ".join(words), "xx"))
        labels.append((i, 1, int(toxic)))
    return (
        spark.createDataFrame(docs, "doc_id long, text string, toxic string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_toxicity_held_out(spark, toxic_tables):
    docs, labels = toxic_tables
    model = ordinal.train(docs, labels.filter("doc_id < 400"))
    rows = ordinal.score_toxicity(docs.filter("doc_id >= 400"), model).collect()
    assert len(rows) == 200 and all(r.toxic == (r.doc_id % 4 == 0) for r in rows)
    assert model.thresholds[0] < model.thresholds[1]
    assert all(0 <= r.expected_severity <= 2 and 0 <= r.severity <= 2 for r in rows)
    # More kinds of toxic words, higher expected severity.
    mild, severe = (sum(model.above(t)) for t in ("river blarg", "river blarg snorf grunk vlim"))
    assert severe > mild
    kept = ordinal.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in range(600) if i % 4]


def test_gradient_of_the_cumulative_link():
    rng = np.random.default_rng(0)
    score, grade, t = rng.normal(size=9), np.array([0, 1, 2] * 3), np.array([-0.4, 0.7])
    weight = rng.random(9) + 0.5

    def loss(score, t):
        above = np.column_stack([np.ones(9), ordinal._sigmoid(score[:, None] - t), np.zeros(9)])
        return -(weight * np.log(above[np.arange(9), grade] - above[np.arange(9), grade + 1])).mean()

    by_score, by_t = ordinal._gradient(score, grade, weight, t)
    for i in range(9):
        d = np.eye(9)[i] * 1e-6
        assert math.isclose(by_score[i], (loss(score + d, t) - loss(score - d, t)) / 2e-6, rel_tol=1e-4, abs_tol=1e-8)
    for i in range(2):
        d = np.eye(2)[i] * 1e-6
        assert math.isclose(by_t[i], (loss(score, t + d) - loss(score, t - d)) / 2e-6, rel_tol=1e-4, abs_tol=1e-8)


def test_toxicity_of_odd_rows(spark, edge_docs, edge_rows, no_docs, toxic_tables):
    _, labels = toxic_tables
    model = ordinal.train(edge_docs, labels.filter("false"))
    rows = ordinal.score_toxicity(edge_docs, model).collect()
    assert len(rows) == len(edge_rows) and not any(r.toxic for r in rows)
    odd = spark.createDataFrame([(None, 1), (7, None), (1, 1), (1, 0), (8, 0)], "doc_id long, toxic int")
    assert len(ordinal.score_toxicity(edge_docs, ordinal.train(edge_docs, odd)).collect()) == len(edge_rows)
    assert ordinal.score_toxicity(no_docs, ordinal.train(no_docs, labels)).count() == 0


# --- byte-level BPE --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return bpe.ByteBPE.from_file(RANKS, public_tokenizers.PATTERN)


def test_bpe_equals_the_library(spark, edge_docs, edge_rows, no_docs, codec):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    want = Counter()
    for i, t in texts_of(edge_rows):
        ids = library.encode_ordinary(t)
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want[i, len(ids), digest, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(edge_docs, RANKS, public_tokenizers.PATTERN).collect()) == want
    ids = {r.doc_id: r.ids for r in bpe.encode_documents(edge_docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert ids[13] == library.encode_ordinary(dict(texts_of(edge_rows))[13]) and ids[5] == []
    assert bpe.round_trip(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_on_long_and_strange_pieces(codec):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for text in ("ab" * 3000, "\n" * 2000, "é" * 700, "\x00\x01 \x7f", "  a", "x\x85\xa0y", "😀" * 300, "1" * 50):
        assert codec.encode(text) == library.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()


# --- sharding --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("run_bytes", [1 << 30, 2000])
def test_shards(spark, edge_docs, edge_rows, no_docs, plan_of, run_bytes):
    df = sharding.shard_documents(edge_docs, 7, run_bytes=run_bytes)
    assert "Python" not in plan_of(df) and "Arrow" not in plan_of(df)
    got = df.collect()
    want = Counter((i, 16 + len(t.encode()), zlib.crc32(t.encode())) for i, t in texts_of(edge_rows))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(7))
    assert sharding.shard_documents(no_docs).count() == 0


def test_shards_are_near_equal_with_one_hot_text(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("the same text " * 4)).otherwise(
            F.concat(F.lit("text "), F.hex(F.xxhash64("id")), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")))
        ).alias("text"),
    )
    sizes = sharding.shard_documents(docs, 40).groupBy("shard").agg(F.sum("size").alias("n")).toPandas().n
    mean = sizes.sum() / 40
    assert len(sizes) == 40 and sizes.max() - mean <= 140 and mean - sizes.min() <= 140


def test_splitters_do_not_depend_on_the_partitioning(spark, edge_docs):
    a, b = (sharding.shard_documents(d, 5).select("doc_id", "shard", "text_crc32") for d in (edge_docs, edge_docs.repartition(2)))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


# --- licences --------------------------------------------------------------------------------------------------


def brute_licences(text):
    import re

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licence_notices(spark, edge_docs, edge_rows, no_docs):
    got = licences.scan_licences(edge_docs).collect()
    base = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got)
    assert base == Counter((i, *brute_licences(t)) for i, t in texts_of(edge_rows))
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    tagged = next(r for r in got if r.doc_id == 20)
    assert tagged.labels == "apache-2,cc-by-nc,gpl-2,mit" and tagged.score == 0.2
    assert licences.scan_licences(no_docs).count() == 0


def test_licence_expressions():
    assert licences.postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert licences.postfix("(a or b) and c") == ["a", "b", "or", "c", "and"]
    for broken in ("", "and a", "a or", "(a", "a)", "()", "a or or b"):
        assert licences.postfix(broken) is None
    assert licences.evaluate("MIT OR GPL-3.0-or-later") == ({"mit", "gpl-3"}, 1.0)
    assert licences.evaluate("MIT AND GPL-3.0-only") == ({"mit", "gpl-3"}, 0.4)
    assert licences.evaluate("GPL-2.0-only WITH Classpath-exception-2.0") == ({"gpl-2"}, 0.5)


def test_overlapping_places_all_count():
    assert licences.scan("cc by nc cc by nc, CC-BY-NC 4.0")[:4] == (11, 3, 0, 6)


# --- Katz ------------------------------------------------------------------------------------------------------


def brute_katz(rows):
    docs = [(i, [*t.encode().lower().split(), b"</s>"]) for i, t in texts_of(rows)]
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs]
    one, two, follow, n_docs = Counter(), Counter(), defaultdict(set), 0
    for (_, words), out in zip(docs, held):
        if not out:
            n_docs += 1
            one.update(words)
            for pair in zip([b"<s>", *words], words):
                two[pair] += 1
                follow[pair[0]].add(pair[1])
    total, types = sum(one.values()), len(one)

    def discount(counts):
        n = Counter(counts.values())
        return katz.Discount.from_frequencies([n[r] for r in range(1, katz.RELIABLE + 2)])

    d1, d2 = discount(one), discount(two)
    kept = lambda d, c: d.kept[c] if c <= katz.RELIABLE else c - katz.SPARED
    rest = 1 - sum(kept(d1, c) for c in one.values()) / total if total else 1.0
    single = lambda w: kept(d1, one[w]) / total if one[w] else rest

    def probability(h, w):
        seen = n_docs if h == b"<s>" else one[h]
        if not seen:
            return single(w)
        if two[h, w]:
            return kept(d2, two[h, w]) / seen
        left = 1 - sum(kept(d2, two[h, x]) for x in follow[h]) / seen
        return left / (1 - sum(single(x) for x in follow[h])) * single(w)

    for h in [b"<s>", *list(one)[:20]]:
        if h != b"</s>":
            assert math.isclose(sum(probability(h, w) for w in one) + probability(h, b"never seen"), 1, abs_tol=1e-9)
    out = []
    for (i, words), h in zip(docs, held):
        base = sum(math.log10((one[w] + 0.1) / (total + 0.1 * (types + 1))) for w in words)
        score = sum(math.log10(probability(a, b)) for a, b in zip([b"<s>", *words], words))
        out.append((i, h, len(words), sum(one[w] > 0 for w in words), total, base, score))
    return out


def _sorted(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[6]))


@pytest.mark.parametrize("chunk_bytes,hot", [(1 << 24, 1 << 18), (600, 3)])
def test_katz_scores(spark, edge_docs, edge_rows, no_docs, monkeypatch, chunk_bytes, hot):
    monkeypatch.setattr(katz, "HOT_HISTORY", hot)
    got = _sorted(tuple(r) for r in katz.score_documents(edge_docs, chunk_bytes=chunk_bytes).collect())
    want = _sorted(brute_katz(edge_rows))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9)
    assert katz.score_documents(no_docs).count() == 0


def test_katz_without_training_documents(spark):
    rows = [(None, "a b"), (None, None)]
    got = katz.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.held_out, r.train_tokens, r.score) for r in got] == [(True, 0, 0.0)] * 2
