from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id long, text string, lang string, value string, key string, chunk string, bucket long, sizes string"


def _words(rng: random.Random, n: int) -> str:
    stems = ["ta", "re", "mi", "lo", "ün", "ké", "sa", "do"]
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """NULLs in every column, empty and long texts, ties, repeated rows, near copies, shared passages."""
    rng = random.Random(3)
    passage = _words(rng, 40)
    base = _words(rng, 120)
    texts = {
        1: base,
        2: base,
        3: base + " tail",
        4: None,
        5: "",
        6: " \t\n ",
        7: _words(rng, 3),
        8: _words(rng, 12_000),
        9: "a" * 1500,
        10: passage + " " + _words(rng, 60),
        11: _words(rng, 50) + " " + passage + " " + _words(rng, 20),
        12: passage,
        13: "Don't stop; Released under the MIT License. 123 日本語 \U0001f600 x\x1cy\x85z",
        14: passage + passage,
        20: "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nLicensed under CC BY-NC 4.0. Apache License, Version 2.0",
        30: _words(rng, 200),
    }
    rows = [(i, t, "xx", "v", "k", "c", 1, "s") for i, t in texts.items()]
    rows += [(1, texts[1], "xx", "v", "k", "c", 1, "s"), (30, texts[30], None, None, None, None, None, None)]
    rows += [(None, texts[7], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    rows += [(100 + i, _words(rng, rng.randint(0, 80)), "xx", "v", "k", "c", i, "s") for i in range(60)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
