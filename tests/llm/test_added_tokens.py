"""Texts that hold the tokenizer's added tokens, against the unmodified tokenizer."""

from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_added_tokens_in_a_text_are_one_id_each(spark, monkeypatch):
    texts = [
        "first part <|endoftext|> second<|startoftext|>third",
        "<|endoftext|><|endoftext|>",
        "<|ENDOFTEXT|> <|endoftext| <|StartOfText|> don<|endoftext|>'t",
        "Été<|startoftext|>É́ <<|endoftext|>>",
        "none of them",
    ]
    tokenizer = Tokenizer.from_file(WORDS)
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack_documents(docs, WORDS, with_ids=True).collect()
    assert {r.doc_id: list(r.ids) for r in got} == dict(enumerate(want))
    assert all(r.doc_tokens == len(want[r.doc_id]) for r in got)
    # A full memory keeps the added tokens.
    monkeypatch.setattr(packing, "REMEMBERED", 1)
    monkeypatch.setattr(packing, "TEXT_BLOCK", 1)
    words = packing.WordTokenizer(WORDS)
    order = [4, 0, 4, 1, 2, 3, 0]
    assert [len(b) // 4 for b in words.encode([texts[i] for i in order])] == [len(want[i]) - 1 for i in order]
