"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights.

P(w | h) = d(c) c / c(h) where the pair (h, w) was seen c times in training, else alpha(h) P(w);
P(w) = d(c) c / N for a known word, and all unknown words share one class with the rest of the mass.
d follows Good and Turing up to ``RELIABLE`` counts; a larger count gives up ``SPARED`` of a count, so that every
history leaves something to unseen words. alpha(h) is what the seen words leave, divided by the probability
that unseen ones have without history; it is computed from all words seen after h, so each history sums to 1.

Counts live in partitioned tables, by word and by history. Chunks of tokenised documents send their distinct
words, then their distinct pairs, and get global counts back; a score is then a lookup within the chunk.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import pack, unpack
from tidemark.llm.common import give_back, id_and_text, id_text_pairs, input_bytes, ship
from tidemark.session import materialise, scratch_path

RELIABLE, SPARED = 5, 0.05
#: Text of one chunk, and the text whose pairs meet in one task.
CHUNK_BYTES, BUCKET_BYTES = 1 << 24, 1 << 24
#: A history seen more often is spread over parts by the following word.
HOT_HISTORY = 1 << 18
END, START, UNKNOWN = 0, (1 << 62), (1 << 62) + 1
_END_WORD = b"\n"  # no word holds white space
_CHUNK = "chunk long, doc_ids binary, sizes binary, tokens binary, words binary"
_MESSAGE = "bucket int, chunk long, packed binary, words binary"
_ANSWER = "bucket int, chunk long, packed binary"
SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def held_out(doc_id: int | None) -> bool:
    """A tenth of the documents, by their id; a NULL id reads as empty text and is held out."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _tokenised(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Chunks of word numbers. Words are numbered by first appearance in the chunk; 0 is the end of a text."""
    made = TaskContext.get().partitionId() << 32

    def chunk(ids: list, tokens: list[np.ndarray], numbers: dict[bytes, int]) -> pa.RecordBatch:
        nonlocal made
        made += 1
        flat = np.concatenate(tokens)
        return pa.RecordBatch.from_pydict(
            {
                "chunk": pa.array([made - 1], pa.int64()),
                "doc_ids": pa.array([",".join("" if i is None else str(i) for i in ids).encode()], pa.binary()),
                "sizes": pa.array([np.array([len(t) for t in tokens], np.int64).tobytes()], pa.binary()),
                "tokens": pa.array([zstandard.compress(flat.tobytes(), 3)], pa.binary()),
                "words": pa.array([zstandard.compress(b" ".join(numbers), 3)], pa.binary()),
            }
        )

    def numbering() -> dict[bytes, int]:
        numbers = defaultdict(count().__next__)
        numbers[_END_WORD]
        return numbers

    ids, tokens, numbers, size = [], [], numbering(), 0
    for batch_ids, texts in id_text_pairs(batches):
        for doc_id, text in zip(batch_ids, texts):
            words = text.encode("utf-8", "surrogatepass").lower().split()
            ids.append(doc_id)
            tokens.append(np.fromiter(chain(map(numbers.__getitem__, words), [END]), np.uint32, len(words) + 1))
            size += len(text)
            if size >= chunk_bytes:
                yield chunk(ids, tokens, numbers)
                ids, tokens, numbers, size = [], [], numbering(), 0
    if ids:
        yield chunk(ids, tokens, numbers)
    del ids, tokens, numbers
    give_back()


class _Chunk:
    """Token numbers of a chunk, the document of each token, and which documents train."""

    def __init__(self, row):
        self.ids = [int(i) if i else None for i in row["doc_ids"].decode().split(",")]
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        raw = zstandard.decompress(row["tokens"], max_output_size=1 << 32)
        self.tokens = np.frombuffer(raw, np.uint32)
        self.words = zstandard.decompress(row["words"], max_output_size=1 << 32).split(b" ")
        self.held = np.array([held_out(i) for i in self.ids])
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)
        self.trains = ~self.held[self.doc]
        self.bucket_of_word = np.array([zlib.crc32(w) for w in self.words], np.int64)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(part):
            yield int(bucket[part[0]]), part


def _send_words(frames: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for _, row in frame.iterrows():
            c = _Chunk(row)
            counts = np.bincount(c.tokens[c.trains], minlength=len(c.words)).astype(np.uint32)
            rows = [
                (b, row["chunk"], pack(counts[part]), zstandard.compress(b" ".join([c.words[i] for i in part]), 3))
                for b, part in _by_bucket(c.bucket_of_word % buckets)
            ]
            del c
            yield pd.DataFrame(rows, columns=["bucket", "chunk", "packed", "words"])
    give_back()


def _frequencies(counts: np.ndarray) -> np.ndarray:
    """Tokens, types, and the types seen 1 .. RELIABLE + 1 times."""
    few = np.bincount(counts[counts <= RELIABLE + 1], minlength=RELIABLE + 2)[1:]
    return np.array([counts.sum(), np.count_nonzero(counts), *few], np.uint64)


def _answer_words(frame: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Global training counts and word ids, and a row (chunk -1) with the frequencies of this bucket."""
    bucket = int(frame["bucket"].iat[0])
    words = [zstandard.decompress(w, max_output_size=1 << 32).split(b" ") for w in frame["words"]]
    totals: dict[bytes, int] = {}
    for own, packed in zip(words, frame["packed"]):
        for word, n in zip(own, unpack(packed)[0].tolist()):
            totals[word] = totals.get(word, 0) + n
    ids = {word: i * buckets + bucket for i, word in enumerate(sorted(w for w, n in totals.items() if n))}
    rows = [
        (bucket, chunk, pack(np.array([totals[w] for w in own], np.uint64), np.array([ids.get(w, UNKNOWN) for w in own], np.uint64)))
        for chunk, own in zip(frame["chunk"], words)
    ]
    rows.append((bucket, -1, pack(_frequencies(np.array([n for n in totals.values() if n], np.int64)))))
    del words, totals, ids
    give_back()
    return pd.DataFrame(rows, columns=["bucket", "chunk", "packed"])


@dataclass(frozen=True)
class Discount:
    """Counts after discounting."""

    kept: tuple[float, ...]  # of the counts 0 .. RELIABLE

    @classmethod
    def from_frequencies(cls, types: list[int]) -> Discount:
        """Good-Turing with Katz's correction: counts over RELIABLE are taken as reliable.

        ``types[r - 1]`` types were seen r times. Where the formula leaves (0, r), as it can on small counts,
        half a count is given up instead.
        """
        n = [0, *types]
        k = RELIABLE
        kept = [0.0]
        for r in range(1, k + 1):
            value = -1.0
            if n[1] and n[r]:
                common = (k + 1) * n[k + 1] / n[1]
                if common < 1:
                    value = r * ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
            kept.append(value if 0 < value < r else r - 0.5)
        return cls(tuple(kept))

    def of(self, counts: np.ndarray) -> np.ndarray:
        table = np.array(self.kept)
        return np.where(counts <= RELIABLE, table[np.minimum(counts, RELIABLE)], counts - SPARED)


@dataclass(frozen=True)
class Unigrams:
    tokens: int
    types: int
    few: tuple[int, ...]

    @property
    def discount(self) -> Discount:
        return Discount.from_frequencies(list(self.few))

    @property
    def unknown(self) -> float:
        """Probability of the class of unknown words."""
        if not self.tokens:
            return 1.0
        kept = sum(n * v for n, v in zip(self.few[:RELIABLE], self.discount.kept[1:]))
        many_types = self.types - sum(self.few[:RELIABLE])
        many = self.tokens - sum(r * n for r, n in enumerate(self.few[:RELIABLE], 1))
        return (self.tokens - kept - (many - SPARED * many_types)) / self.tokens

    def probability(self, counts: np.ndarray) -> np.ndarray:
        known = self.discount.of(counts) / max(1, self.tokens)
        return np.where(counts > 0, known, self.unknown)


class _Pairs(_Chunk):
    """The distinct pairs of a chunk, with ids and counts of both words, and where each goes."""

    def __init__(self, row, answers: pd.DataFrame, word_buckets: int, buckets: int, documents: int):
        super().__init__(row)
        order = np.argsort(self.bucket_of_word % word_buckets, kind="stable")
        counts, ids = [np.concatenate(c) for c in zip(*[unpack(b) for b in answers.sort_values("bucket")["packed"]])]
        self.count = np.empty(len(self.words), np.int64)
        self.id = np.empty(len(self.words), np.int64)
        self.count[order], self.id[order] = counts, ids
        starts = np.cumsum(self.sizes) - self.sizes
        begin = len(self.words)
        # One array of a number for each token at a time: history * (begin + 1) + token
        key = np.empty(len(self.tokens), np.int64)
        key[1:] = self.tokens[:-1]
        key[starts] = begin
        key *= begin + 1
        key += self.tokens
        self.history_count = np.append(self.count, documents)
        history_id = np.append(self.id, START)
        key, pair_of = np.unique(key, return_inverse=True)
        self.pair_of = pair_of.astype(np.int32)
        del pair_of
        self.h, self.w = key // (begin + 1), key % (begin + 1)
        self.seen_here = np.bincount(self.pair_of[self.trains], minlength=len(key))
        held = np.zeros(len(key), bool)
        held[self.pair_of[~self.trains]] = True
        # What can be in the table: both words known. Documents held out also ask what their histories leave.
        known = self.history_count[self.h] > 0
        ask = np.flatnonzero(known & (self.count[self.w] > 0))
        hid, wid = history_id[self.h[ask]], self.id[self.w[ask]]
        order = np.lexsort((wid, hid))
        self.ask, self.hid, self.wid = ask[order], hid[order], wid[order]
        parts = 1 + self.history_count[self.h[self.ask]] // HOT_HISTORY
        self.bucket = _bucket(self.hid, self.wid % parts, buckets)
        self.rest_h = np.unique(self.h[held & known])
        parts = 1 + self.history_count[self.rest_h] // HOT_HISTORY
        self.rest_owner = np.repeat(np.arange(len(self.rest_h)), parts)
        part = np.arange(len(self.rest_owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.rest_id = history_id[self.rest_h][self.rest_owner]
        self.rest_bucket = _bucket(self.rest_id, part, buckets)
        # Parts of one history that share a bucket are one question.
        _, first = np.unique(np.stack([self.rest_owner, self.rest_bucket]), axis=1, return_index=True)
        first = np.sort(first)
        self.rest_owner, self.rest_id, self.rest_bucket = self.rest_owner[first], self.rest_id[first], self.rest_bucket[first]


def _bucket(history: np.ndarray, part: np.ndarray, buckets: int) -> np.ndarray:
    x = (history.astype(np.uint64) + np.uint64(0x9E3779B9) * part.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _send_pairs(_key, chunk: pd.DataFrame, answers: pd.DataFrame, **options) -> pd.DataFrame:
    rows = []
    for _, row in chunk.iterrows():
        p = _Pairs(row, answers, **options)
        questions = dict(_by_bucket(p.bucket))
        rests = dict(_by_bucket(p.rest_bucket))
        none = np.zeros(0, np.int64)
        for b in questions.keys() | rests.keys():
            own, rest = questions.get(b, none), rests.get(b, none)
            pairs = pack(
                p.hid[own], p.wid[own].astype(np.uint64), p.seen_here[p.ask[own]].astype(np.uint32),
                p.count[p.w[p.ask[own]]].astype(np.uint64),
            )
            rows.append((b, row["chunk"], pairs, pack(np.sort(p.rest_id[rest]))))
        del p, questions, rests
    give_back()
    return pd.DataFrame(rows, columns=["bucket", "chunk", "packed", "words"])


def _answer_pairs(frame: pd.DataFrame, unigrams: Unigrams) -> pd.DataFrame:
    """Global counts of the pairs, and what is needed for the rest of each asked history.

    For a history: types seen 1 .. RELIABLE times, types and tokens seen more often, and the probability
    without history of all its seen words. A row (chunk -1) has the frequencies of this bucket.
    """
    bucket = int(frame["bucket"].iat[0])
    blocks = [unpack(b) for b in frame["packed"]]
    edges = np.cumsum([len(b[0]) for b in blocks])
    h, w, here, count_w = (np.concatenate(c) for c in zip(*blocks))
    del blocks
    order = np.lexsort((w, h))
    h, w = h[order], w[order]
    new = np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    total = np.add.reduceat(here[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    answer = np.empty(len(h), np.uint64)
    answer[order] = total[np.cumsum(new) - 1]

    seen = total > 0
    names, which = np.unique(h[first][seen], return_inverse=True)
    counts, p = total[seen], unigrams.probability(count_w[order[first[seen]]].astype(np.int64))
    del h, w, here, count_w, order, new, first, total, seen
    few = [np.bincount(which[counts == r], minlength=len(names)) for r in range(1, RELIABLE + 1)]
    many = counts > RELIABLE
    table = np.array(
        [
            *few,
            np.bincount(which[many], minlength=len(names)),
            np.bincount(which[many], counts[many], len(names)),
            np.bincount(which, p, len(names)),
        ]
    )
    rows = []
    for chunk, part, rest in zip(frame["chunk"], np.split(answer, edges[:-1]), frame["words"]):
        asked = unpack(rest)[0]
        at = np.minimum(np.searchsorted(names, asked), max(0, len(names) - 1))
        there = (names[at] == asked) if len(names) else np.zeros(len(asked), bool)
        values = np.where(there, table[:, at], 0.0) if len(names) else np.zeros((len(table), len(asked)))
        rows.append((bucket, chunk, pack(part), pack(*values)))
    rows.append((bucket, -1, pack(_frequencies(counts)), b""))
    del answer, table, which, counts, p, many
    give_back()
    return pd.DataFrame(rows, columns=["bucket", "chunk", "packed", "words"])


def _score(_key, chunk: pd.DataFrame, answers: pd.DataFrame, unigrams: Unigrams, discount: Discount, **options) -> pd.DataFrame:
    out = []
    for _, row in chunk.iterrows():
        step = answers["step"].to_numpy()
        p = _Pairs(row, answers[step == 0], **options)
        seen = np.zeros(len(p.h), np.int64)
        left = np.zeros((RELIABLE + 3, len(p.rest_h)))
        asked, rests = dict(_by_bucket(p.bucket)), dict(_by_bucket(p.rest_bucket))
        for b, counts, table in answers.loc[step == 1, ["bucket", "packed", "words"]].itertuples(index=False):
            if b in asked:
                seen[p.ask[asked[b]]] = unpack(counts)[0].astype(np.int64)
            if b in rests:
                own = rests[b]
                own = own[np.argsort(p.rest_id[own], kind="stable")]
                np.add.at(left.T, p.rest_owner[own], np.array(unpack(table)).T)
        history = p.history_count.astype(float)
        kept = np.array(discount.kept[1:]) @ left[:RELIABLE] + left[RELIABLE + 1] - SPARED * left[RELIABLE]
        alpha = np.ones(len(p.history_count))
        alpha[p.rest_h] = (1 - kept / history[p.rest_h]) / (1 - left[-1])
        single = unigrams.probability(p.count)
        with np.errstate(divide="ignore"):
            pair = np.where(seen > 0, discount.of(seen) / np.maximum(1, history[p.h]), alpha[p.h] * single[p.w])
            pair = np.log10(pair)
        single = np.log10((p.count + 0.1) / (unigrams.tokens + 0.1 * (unigrams.types + 1)))
        n = len(p.ids)
        out.append(
            pd.DataFrame(
                {
                    "doc_id": pd.array(p.ids, "Int64"),
                    "held_out": p.held,
                    "n_tokens": p.sizes,
                    "n_known": np.bincount(p.doc, p.count[p.tokens] > 0, n).astype(np.int64),
                    "train_tokens": unigrams.tokens,
                    "base_score": np.bincount(p.doc, single[p.tokens], n),
                    "score": np.bincount(p.doc, pair[p.pair_of], n),
                }
            )
        )
        del p, seen, left, asked, rests, history, kept, alpha, single, pair
    give_back()
    return pd.concat(out) if out else pd.DataFrame()


def _summed(answers: DataFrame) -> list[int]:
    """The frequencies of all buckets; one short row per bucket."""
    rows = answers.filter(F.col("chunk") == -1).select("packed").collect()
    return np.sum([unpack(r["packed"])[0] for r in rows], axis=0).astype(np.int64).tolist() if rows else [0] * (RELIABLE + 3)


def score_documents(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Bigram Katz model of the training documents; log10 probability of every document.

    Texts are lower-cased (A-Z) and split at ASCII white space; each ends with one end token. Documents whose
    ``crc32(doc_id) mod 10`` is not 0 train. The first token has the beginning of a text as its history.
    ``base_score`` is the additive unigram score. A NULL or empty text is its end token alone. Rows with a
    NULL id are held out. Repeated rows count and appear each. Without training documents every token has
    probability 1 (one class holds everything); an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = id_and_text(docs)
    total = input_bytes(rows)
    buckets = int(max(12, -(-total // bucket_bytes)))
    name = f"tokens_{uuid.uuid4().hex}"
    (
        rows.mapInArrow(partial(_tokenised, chunk_bytes=chunk_bytes), _CHUNK)
        .write.bucketBy(int(max(12, min(1 << 14, total // chunk_bytes))), "chunk")
        .option("path", scratch_path(spark, "tokens"))
        .option("compression", "none")  # the blocks are compressed already
        .saveAsTable(name)
    )
    chunks = spark.table(name)
    words = materialise(
        chunks.mapInPandas(partial(_send_words, buckets=buckets), _MESSAGE)
        .groupBy("bucket")
        .applyInPandas(partial(_answer_words, buckets=buckets), _ANSWER),
        "word-counts",
    )
    tokens, types, *few = _summed(words)
    unigrams = Unigrams(tokens, types, tuple(few))
    training = rows.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0)
    options = {"word_buckets": buckets, "buckets": buckets, "documents": training.count()}
    found = words.filter(F.col("chunk") >= 0)
    pairs = materialise(
        chunks.groupBy("chunk")
        .cogroup(found.groupBy("chunk"))
        .applyInPandas(partial(_send_pairs, **options), _MESSAGE)
        .groupBy("bucket")
        .applyInPandas(partial(_answer_pairs, unigrams=unigrams), _MESSAGE),
        "pair-counts",
    )
    discount = Discount.from_frequencies(_summed(pairs)[2:])
    answers = found.select("*", F.lit(None).cast("binary").alias("words"), F.lit(0).alias("step")).unionByName(
        pairs.filter(F.col("chunk") >= 0).withColumn("step", F.lit(1))
    )
    return (
        chunks.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInPandas(partial(_score, unigrams=unigrams, discount=discount, **options), SCORES)
    )
