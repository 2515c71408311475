"""What a task holds of a chunk, for each of its tokens."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import zstandard

from tidemark.llm import katz
from tidemark.llm.chunks import pack

TOKENS, WORDS = 400_000, 500


def _bytes_a_token() -> tuple[float, float]:
    """At the end and at the most, of the pairs of one chunk."""
    rng = np.random.default_rng(5)
    tokens = rng.integers(0, WORDS, TOKENS).astype(np.uint32)
    sizes = np.full(100, TOKENS // 100, np.int64)
    row = {
        "doc_ids": ",".join(map(str, range(100))).encode(),
        "sizes": sizes.tobytes(),
        "tokens": zstandard.compress(tokens.tobytes()),
        "words": zstandard.compress(b" ".join(b"\n" if i == 0 else str(i).encode() for i in range(WORDS))),
    }
    ones = np.ones(WORDS, np.uint64)
    answers = pd.DataFrame([(0, pack(ones, np.arange(WORDS, dtype=np.uint64)))], columns=["bucket", "packed"])
    tracemalloc.start()
    pairs = katz._Pairs(row, answers, word_buckets=1, buckets=4, documents=90)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(pairs.pair_of) == TOKENS
    pair = pairs.h[pairs.pair_of] * (WORDS + 1) + pairs.w[pairs.pair_of]
    starts = np.arange(0, TOKENS, TOKENS // 100)
    history = np.append(WORDS, tokens[:-1].astype(np.int64))
    history[starts] = WORDS
    assert (pair == history * (WORDS + 1) + tokens).all()
    return held / TOKENS, most / TOKENS


def test_pairs_of_a_chunk_are_small():
    held, most = _bytes_a_token()
    assert held < 46 and most < 86
