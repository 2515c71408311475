"""Byte-level BPE over padded numpy matrices.

Distinct pieces of text are grouped by length. Each group is one matrix of token ids; in every round each row
merges its leftmost pair of minimum rank, found by an open-addressing hash table over pairs, and the matrix
is compacted by one column. Rows without a pair leave.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from tidemark.llm.common import id_and_text, id_text_pairs, ship

_NONE = np.int64(1 << 40)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Cells of one matrix; larger groups are cut into several.
MATRIX_CELLS = 1 << 20
#: Pieces remembered by a worker; a full memory keeps those of the text at hand.
REMEMBERED = 400_000
#: Characters of text whose distinct pieces are merged together.
TEXT_BLOCK = 1 << 22
#: Groups of padded lengths; a piece goes to the first that holds it. Longer ones get a matrix of their own length.
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 48, 64, 128, 256, 512, 1024)

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


class ByteBPE:
    """Encoder and decoder for a rank file (lines of base64 token and rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.full(256, -1, np.int64)
        for b in range(256):
            if bytes([b]) in ranks:
                self.byte_ids[b] = ranks[bytes([b])]
        pairs = [
            (ranks[token[:i]], ranks[token[i:]], rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        self.ranks = ranks
        self._build(np.array(pairs or np.empty((0, 3)), np.int64))
        self.decimals = {rank: str(rank) for rank in self.tokens}
        self.memory: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}, pattern)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _build(self, pairs: np.ndarray) -> None:
        """Open addressing with linear probing, filled by rounds: whoever finds its slot free takes it."""
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, _NONE, np.int64)
        keys, values = pairs[:, 0] << 32 | pairs[:, 1], pairs[:, 2]
        slots, self.probes = self._slot(keys), 1
        while len(keys):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]
            self.values[slots[free]] = values[free]
            placed = self.keys[slots] == keys
            self.values[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], (slots[~placed] + 1) & (size - 1)
            self.probes += bool(len(keys))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a value above all ranks."""
        keys = np.where((left < 0) | (right < 0), np.int64(-2), left << 32 | right)
        slots = self._slot(keys)
        found = np.where(self.keys[slots] == keys, self.values[slots], _NONE)
        open_ = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] != -1) & (keys != -2))
        for step in range(1, self.probes):
            if not len(open_):
                break
            at = (slots[open_] + step) & (len(self.keys) - 1)
            hit = self.keys[at] == keys[open_]
            found[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (self.keys[at] != -1)]
        return found

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        lengths = np.array([len(p) for p in pieces])
        raw = np.zeros((len(pieces), width), np.uint8)
        raw[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.where(np.arange(width) < lengths[:, None], self.byte_ids[raw], -1)
        done: list = [()] * len(pieces)
        rows = np.arange(len(pieces))
        ranks = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), _NONE)
            merging = best < _NONE
            if not merging.all():
                left = ids[~merging]
                for row, length, line in zip(rows[~merging].tolist(), (left >= 0).sum(1).tolist(), left.tolist()):
                    done[row] = line[:length]
            rows, ids, ranks, at, best = rows[merging], ids[merging], ranks[merging], at[merging], best[merging]
            if not len(rows):
                break
            line = np.arange(len(rows))
            ids[line, at] = best
            keep = np.ones(ids.shape, bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
            keep = np.ones(ranks.shape, bool)
            keep[line, at] = False
            ranks = ranks[keep].reshape(len(rows), -1)
            for shift in (-1, 0):
                pair = at + shift
                ok = (pair >= 0) & (pair < ranks.shape[1])
                r, p = line[ok], pair[ok]
                ranks[r, p] = self.pair_ranks(ids[r, p], ids[r, p + 1])
        return done

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece. Pieces of similar length share a matrix."""
        out = [() if (whole := self.ranks.get(p)) is None else [whole] for p in pieces]
        open_ = np.array([i for i, ids in enumerate(out) if not ids and pieces[i]], np.int64)
        lengths = np.array([len(pieces[i]) for i in open_], np.int64)
        group = np.searchsorted(WIDTHS, lengths)
        widths = np.where(group < len(WIDTHS), np.array([*WIDTHS, 0])[group], lengths)
        for width in np.unique(widths).tolist():
            members = open_[widths == width].tolist()
            step = max(1, MATRIX_CELLS // width)
            for start in range(0, len(members), step):
                part = members[start : start + step]
                for i, ids in zip(part, self._merge_matrix([pieces[j] for j in part], width)):
                    out[i] = ids
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def encode_texts(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; each distinct piece of a few MB of text is merged once."""
        start = 0
        while start < len(texts):
            split, size = [], 0
            while start < len(texts) and (not split or size < TEXT_BLOCK):
                split.append(self.pattern.findall(texts[start]))
                size += len(texts[start])
                start += 1
            self._learn(set(chain.from_iterable(split)))
            for pieces in split:
                yield list(chain.from_iterable(map(self.memory.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_texts([text]))

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the decoded bytes."""
        return [
            (
                len(ids),
                hashlib.sha256(",".join(map(self.decimals.__getitem__, ids)).encode()).hexdigest(),
                hashlib.sha256(self.decode(ids)).hexdigest(),
            )
            for ids in self.encode_texts(texts)
        ]

    def _learn(self, pieces: set[str]) -> None:
        if len(self.memory) + len(pieces) > REMEMBERED:
            self.memory = {p: self.memory[p] for p in pieces & self.memory.keys()}
        fresh = [p for p in pieces if p not in self.memory]
        self.memory.update(zip(fresh, map(tuple, self.encode_pieces([p.encode() for p in fresh]))))


@lru_cache(maxsize=2)
def _loaded(path: str, pattern: str) -> ByteBPE:
    return ByteBPE.from_file(path, pattern)


def _digest_batches(batches: Iterator[pa.RecordBatch], name: str, pattern: str) -> Iterator[pa.RecordBatch]:
    codec = _loaded(SparkFiles.get(name), pattern)
    for ids, texts in id_text_pairs(batches):
        columns = list(zip(*codec.digests(texts))) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([ids, *columns], _ARROW)], schema=_ARROW)


def _token_batches(batches: Iterator[pa.RecordBatch], name: str, pattern: str) -> Iterator[pa.RecordBatch]:
    codec = _loaded(SparkFiles.get(name), pattern)
    for ids, texts in id_text_pairs(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(list(codec.encode_texts(texts)), pa.list_(pa.int32()))],
            names=["doc_id", "ids"],
        )


def _distributed(docs: DataFrame, ranks: str) -> str:
    """Send the rank file (a vocabulary of fixed size) to the workers; returns its name there."""
    ship(docs.sparkSession)
    docs.sparkSession.sparkContext.addFile(ranks)
    return ranks.rsplit("/", 1)[-1]


def encode_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` (array of int) of every whole text; NULL text: no ids. One row per input row."""
    name = _distributed(docs, ranks)
    return id_and_text(docs).mapInArrow(partial(_token_batches, name=name, pattern=pattern), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Encode every whole text, decode the ids, and return digests of both; one row per input row.

    A NULL text is empty: no tokens, digests of nothing. A NULL id stays NULL; repeated rows repeat. A piece
    of any length is merged whole. A byte that the vocabulary lacks would be lost; the vocabularies used have all 256.
    """
    name = _distributed(docs, ranks)
    return id_and_text(docs).mapInArrow(partial(_digest_batches, name=name, pattern=pattern), SCHEMA)
