"""Periodic runs against brute force over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from tidemark.llm import periodic, queries


def brute(words):
    """Every stretch of equal words at distance q, for every q; only those whose smallest period is q."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        at = 0
        while at < n - q:
            end = at
            while end < n - q and words[end] == words[end + q]:
                end += 1
            length = end - at + q
            if end > at and length >= max(24, 3 * q):
                part = words[at : at + length]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.append((at, length, q))
            at = max(end, at + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    out = []
    for _ in range(rng.randint(0, 8)):
        q, letters = rng.choice([1, 2, 5, 11, 12, 13, 17, 18, 19, 27, 28, 29, 40, 50, 63, 90]), rng.choice([1, 2, 3, 50])
        stem = [rng.randint(0, letters) for _ in range(q)]
        out += (stem * 8)[: rng.randint(0, q * 5)] + [rng.randint(0, letters) for _ in range(rng.randint(0, 10))]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_all_runs_are_found(seed):
    rng = random.Random(seed)
    for _ in range(40):
        docs = [periodic_words(rng) for _ in range(rng.randint(1, 6))]
        words = np.array([w for d in docs for w in d], np.int64)
        assert periodic.find_runs(words, np.array([len(d) for d in docs])) == [brute(d) for d in docs]


def test_every_period_and_place():
    for q in range(1, 130):
        docs = [[-1 - i for i in range(before)] + (list(range(q)) * 60)[: max(24, 3 * q) + more] for before, more in ((0, 0), (7, 1), (40, q))]
        docs = [[w + 1000 for w in d] for d in docs]
        found = periodic.find_runs(np.array(sum(docs, []), np.int64), np.array([len(d) for d in docs]))
        assert found == [[(b, max(24, 3 * q) + m, q)] for b, m in ((0, 0), (7, 1), (40, q))], q


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{x},{q}\n" for s, x, q in runs), " ".join(kept))]
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *sha)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    texts = [" ".join(f"w{w}" for w in periodic_words(rng)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4]), (70, None), (71, ""), (72, " \t\x1c\x85　 é\r\n"), (73, "x\x0by " * 30)]
    columns = "doc_id long, text string, runs string, n int, words int, planted boolean"
    spark.createDataFrame([(i, t, "r", 1, 2, None) for i, t in rows], columns).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected(i, t) for i, t in rows), key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(60)) > 2


def test_no_rows(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("kind", ["one word", "two words", "stem", "random"])
def test_a_very_long_text(kind):
    n = 1_000_000
    words = {"one word": np.zeros(n), "two words": np.arange(n) % 2, "stem": np.arange(n) % 1000, "random": np.random.default_rng(0).integers(0, 5000, n)}
    start = time.monotonic()
    found = periodic.find_runs(words[kind].astype(np.int64), np.array([n]))[0]
    assert found == {"one word": [(0, n, 1)], "two words": [(0, n, 2)], "stem": [(0, n, 1000)], "random": []}[kind]
    assert time.monotonic() - start < 60


def test_strongest_is_exact():
    big = 3 * (1 << 60)
    assert periodic.strongest([(0, big, 1 << 60), (5, big + 1, 1 << 60), (6, big + 1, 1 << 60)]) == (5, big + 1, 1 << 60)
