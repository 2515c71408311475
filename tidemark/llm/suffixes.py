"""Removal of repeated passages: suffixes sorted only to the depth of a passage, by digits, most significant first.

A passage is ``LENGTH`` bytes. Every passage is read from its synchronising position onwards: the place of the
least hash among its ``GRAM``-byte strings, which depends on the passage alone. Consecutive passages mostly
share that place, so one suffix stands for some thirty of them. The passes:

1. digit: the ``GRAM`` bytes at the place. Suffixes alone in their group are unique and finished.
2. digit: everything the suffix stands for. Suffixes equal in it are repeats of the earliest and finished;
   where a first digit holds several such classes, their earliest suffixes go on. A very common first digit is
   counted beforehand and spread by what its suffixes stand for; all its classes go on.
3. digit: each passage of those, to full depth. Equal groups are exactly the repeated passages.

Digits are compared by hashes, of 64 bits each, of the bytes they stand for (passage: 64 bits of the gram and
64 of all its bytes). Chunks of documents send packed digits to buckets and get packed answers back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import CHUNK_BYTES, chunked, contents, pack, unpack
from tidemark.llm.common import give_back, input_bytes
from tidemark.session import materialise

LENGTH, GRAM = 100, 32
#: Text whose first digits meet in one task, and text whose last digits do.
BUCKET_BYTES = 1 << 24
#: Suffixes of one first digit that go on together; the passages of a more common one are spread by their hash.
HOT_SUFFIXES = 1 << 13
#: Suffixes of one first digit that meet in one task; a more common one is spread. Chunks that hold it once do not count.
HOT_GRAM = 1 << 15
#: Passage starts in one block of the search for synchronising positions: positions fit in 16 bits.
_BLOCK = 1 << 16
_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_FIRST_DOC = np.iinfo(np.int64).min
_MESSAGE = "bucket int, chunk long, packed binary"


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _K1
    x ^= x >> np.uint64(29)
    x += b
    x *= _K2
    x ^= x >> np.uint64(32)
    return x


def hash_at(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of the ``length`` bytes at each position."""
    out = np.empty(len(at), np.uint64)
    words = -(-length // 8)
    for start in range(0, len(at), 1 << 14):
        part = at[start : start + (1 << 14)]
        block = np.zeros((len(part), words * 8), np.uint8)
        block[:, :length] = np.lib.stride_tricks.sliding_window_view(data, length)[part]
        columns = block.view(np.uint64)
        x = np.full(len(part), length, np.uint64)
        for w in range(words):
            x = _mix(x, columns[:, w])
        out[start : start + len(part)] = _mix(x, _K3)
    return out


def _runs(data: np.ndarray, ends: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Rows (low, high, at): the passages at the starts low..high have their synchronising position at ``at``.

    The position is the leftmost least hash of the grams of a passage. Blocks of starts are searched one
    after another, so the arrays stay small; a run that meets the end of a block becomes two.
    """
    n = len(data) - length + 1
    runs = [np.zeros((3, 0), np.int64)]
    for start in range(0, n, _BLOCK - length):
        part = data[start : start + _BLOCK]
        h = (part.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
        width = 1
        while width < gram:
            h = (h[:-width] * np.uint32(0x85EBCA6B) ^ (h[:-width] >> np.uint32(15))) + h[width:] * np.uint32(0xC2B2AE35)
            width *= 2
        h *= np.uint32(0x27D4EB2F)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x165667B1)
        least = (h & np.uint32(0xFFFF0000)) | np.arange(len(h), dtype=np.uint32)
        window, width = length - gram + 1, 1
        while 2 * width <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < window:
            least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
        places = (least & np.uint32(0xFFFF)).astype(np.int64) + start
        starts = np.arange(start, start + len(places))
        # Passages do not cross the ends of documents.
        first, last = np.searchsorted(ends, [start, start + len(places)], "right")
        own_ends = ends[first : last + 1]
        own_sizes = np.minimum(own_ends, start + len(places)) - np.maximum(own_ends - sizes[first : last + 1], start)
        inside = starts + length <= np.repeat(own_ends, own_sizes)
        starts, places = starts[inside], places[inside]
        if len(starts):
            new = np.flatnonzero((np.diff(places, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
            runs.append(np.stack([starts[new], starts[np.append(new[1:], len(starts)) - 1], places[new]]))
    return np.concatenate(runs, axis=1)


class _Suffixes:
    """The suffixes of one chunk: passages ``low..high`` share the place ``at``; first and second digits."""

    def __init__(self, row, length: int, gram: int):
        self.data, self.sizes, self.rows = contents(row)
        self.length = length
        self.ends = np.cumsum(self.sizes)
        ids = self.rows.column("doc_id")
        self.ids = ids.fill_null(_FIRST_DOC).to_numpy(zero_copy_only=False).astype(np.int64)
        self.low, self.high, self.at = _runs(self.data, self.ends, self.sizes, length, gram)
        self.gram = hash_at(self.data, self.at, gram)
        both = _mix(hash_at(self.data, self.low, length), hash_at(self.data, self.high, length))
        self.span = _mix(both, ((self.high - self.low) << 16 | (self.at - self.low)).astype(np.uint64))
        self.doc, self.start = self.order_of(self.low)
        #: Repeats within the chunk need no answer.
        self.repeat = ~_earliest(self.gram, self.span, self.doc, self.start)

    def order_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        which = np.searchsorted(self.ends, at, "right")
        return self.ids[which], at - (self.ends - self.sizes)[which]


def _earliest(*keys_doc_start: np.ndarray) -> np.ndarray:
    """True where no row of equal keys has a smaller (doc, start); the last two arrays are these."""
    *keys, doc, start = keys_doc_start
    order = np.lexsort((start, doc, *keys[::-1]))
    if not len(order):
        return np.zeros(0, bool)
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out = np.empty(len(order), bool)
    out[order] = (doc[order] == doc[first]) & (start[order] == start[first])
    return out


def _by_bucket(chunk: int, bucket: np.ndarray, *columns: np.ndarray) -> pd.DataFrame:
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    rows = [
        (int(bucket[part[0]]), chunk, pack(*[c[part] for c in columns]))
        for part in np.split(order, edges[1:])
        if len(part)
    ]
    return pd.DataFrame(rows, columns=["bucket", "chunk", "packed"])


def _count_grams(frames: Iterator[pd.DataFrame], length: int, gram: int) -> Iterator[pd.DataFrame]:
    """The first digits that several suffixes of a chunk have, and how many."""
    for frame in frames:
        for _, row in frame.iterrows():
            s = _Suffixes(row, length, gram)
            grams, n = np.unique(s.gram[~s.repeat], return_counts=True)
            yield pd.DataFrame({"gram": grams[n > 1].view(np.int64), "n": n[n > 1]})


def _parts(gram: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Over how many parts each first digit is spread; ``hot`` has those of more than one in ascending order."""
    grams, parts = hot
    if not len(grams):
        return np.ones(len(gram), np.uint64)
    at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
    return np.where(grams[at] == gram, parts[at], np.uint64(1))


def _suffix_bucket(gram: np.ndarray, span: np.ndarray, buckets: int, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    parts = _parts(gram, hot)
    spread = np.where(parts > 1, _mix(gram, span % parts), gram)
    return (spread % np.uint64(buckets)).astype(np.int64)


def _send_suffixes(frames: Iterator[pd.DataFrame], buckets: int, hot: tuple, length: int, gram: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for _, row in frame.iterrows():
            s = _Suffixes(row, length, gram)
            go = np.flatnonzero(~s.repeat)
            bucket = _suffix_bucket(s.gram[go], s.span[go], buckets, hot)
            yield _by_bucket(row["chunk"], bucket, s.gram[go], s.span[go], s.doc[go], s.start[go])


def _answers(frame: pd.DataFrame, decide: Callable) -> pd.DataFrame:
    """One array of answers per message of a bucket, in the order of the message."""
    blocks = [unpack(b) for b in frame["packed"]]
    sizes = [len(b[0]) for b in blocks]
    columns = [np.concatenate(c) for c in zip(*blocks)]
    del blocks
    answers = decide(*columns)
    del columns
    give_back()
    packed = [pack(a) for a in np.split(answers, np.cumsum(sizes)[:-1])]
    return pd.DataFrame({"bucket": frame["bucket"], "chunk": frame["chunk"], "packed": packed})


def _decide_suffixes(gram, span, doc, start, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 unique, 1 repeat, else 2 + log2 of the parts over which the passages of this first digit are spread.

    A first digit that is spread itself may have other classes in other parts: none of its suffixes is unique.
    """
    earliest = _earliest(gram, span, doc, start)
    order = np.lexsort((span, gram))
    g, s = gram[order], span[order]
    new_gram = np.append(True, g[1:] != g[:-1])
    new_class = new_gram | np.append(True, s[1:] != s[:-1])
    which = np.cumsum(new_gram) - 1
    classes = np.bincount(which, new_class).astype(np.int64)[which]
    spread = _parts(g, hot).astype(np.int64)
    classes = np.where(spread > 1, np.maximum(2, classes * spread), classes)
    parts = np.ceil(np.log2(np.maximum(1, classes / HOT_SUFFIXES))).astype(np.uint8)
    out = np.empty(len(gram), np.uint8)
    out[order] = np.where(classes > 1, 2 + parts, 0)
    out[~earliest] = 1
    return out


def _decide_passages(gram, passage, doc, start) -> np.ndarray:
    return (~_earliest(gram, passage, doc, start)).astype(np.uint8)


def _answer_suffixes(frame: pd.DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
    return _answers(frame, partial(_decide_suffixes, hot=hot))


def _answer_passages(frame: pd.DataFrame) -> pd.DataFrame:
    return _answers(frame, _decide_passages)


def _place_answers(bucket: np.ndarray, answers: pd.DataFrame) -> np.ndarray:
    """Answers put back to where their questions came from."""
    out = np.zeros(len(bucket), np.uint8)
    order = np.argsort(bucket, kind="stable")
    if len(answers):
        answers = answers.sort_values("bucket")
        out[order] = np.concatenate([unpack(b)[0] for b in answers["packed"]])
    return out


class _Passages:
    """What a chunk knows after the second digit: repeated suffixes, and the passages that are still open."""

    def __init__(self, s: _Suffixes, answers: pd.DataFrame, buckets: int, hot: tuple[np.ndarray, np.ndarray]):
        go = np.flatnonzero(~s.repeat)
        status = np.ones(len(s.low), np.uint8)
        status[go] = _place_answers(_suffix_bucket(s.gram[go], s.span[go], buckets, hot), answers)
        self.repeated = status == 1
        open_ = np.flatnonzero(status > 1)
        count = s.high[open_] - s.low[open_] + 1
        owner = np.repeat(open_, count)
        self.at = s.low[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        self.gram = s.gram[owner]
        self.hash = hash_at(s.data, self.at, s.length)
        self.doc, self.start = s.order_of(self.at)
        self.repeat = ~_earliest(self.gram, self.hash, self.doc, self.start)
        spread = self.hash & ((np.uint64(1) << (status[owner].astype(np.uint64) - np.uint64(2))) - np.uint64(1))
        self.bucket = (_mix(self.gram, spread) % np.uint64(buckets)).astype(np.int64)


def _send_passages(_key, chunk: pd.DataFrame, answers: pd.DataFrame, buckets: int, hot: tuple, length: int, gram: int) -> pd.DataFrame:
    out = [pd.DataFrame({"bucket": [], "chunk": [], "packed": []})]
    for _, row in chunk.iterrows():
        p = _Passages(_Suffixes(row, length, gram), answers, buckets, hot)
        go = np.flatnonzero(~p.repeat)
        out.append(
            _by_bucket(row["chunk"], p.bucket[go], p.gram[go], p.hash[go], p.doc[go], p.start[go])
        )
        del p, go
    give_back()
    return out[-1]


def _covered(row, answers: pd.DataFrame, buckets: int, hot: tuple, length: int, gram: int) -> tuple[_Suffixes, np.ndarray]:
    """The chunk, and for each of its bytes whether a passage that also starts earlier covers it."""
    s = _Suffixes(row, length, gram)
    step = answers["step"].to_numpy() if len(answers) else np.zeros(0)
    p = _Passages(s, answers[step == 0], buckets, hot)
    go = np.flatnonzero(~p.repeat)
    p.repeat[go] = _place_answers(p.bucket[go], answers[step == 1]) == 1
    edge = np.zeros(len(s.data) + 1, np.int32)
    np.add.at(edge, s.low[p.repeated], 1)
    np.add.at(edge, s.high[p.repeated] + length, -1)
    np.add.at(edge, p.at[p.repeat], 1)
    np.add.at(edge, p.at[p.repeat] + length, -1)
    del p, go
    give_back()
    return s, np.cumsum(edge[:-1], dtype=np.int32) > 0


def _digest(_key, chunk: pd.DataFrame, answers: pd.DataFrame, buckets: int, hot: tuple, length: int, gram: int) -> pd.DataFrame:
    out = []
    for _, row in chunk.iterrows():
        s, covered = _covered(row, answers, buckets, hot, length, gram)
        for doc_id, end, size in zip(s.rows.column("doc_id").to_pylist(), s.ends.tolist(), s.sizes.tolist()):
            gone = covered[end - size : end]
            kept = s.data[end - size : end][~gone]
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]) if size else 0
            out.append((doc_id, size, size - len(kept), spans, hashlib.sha256(kept.tobytes()).hexdigest()))
    frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return frame.astype({"doc_id": "Int64"})


def _whole_characters(data: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """A character goes only if all its bytes are covered: the ends of covered runs give way to characters they cut."""
    covered = covered.copy()
    step = np.diff(covered.view(np.int8), prepend=0, append=0)
    first, after = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = np.append((data & 0xC0) == 0x80, False)
    back = after[inner[after]] - 1
    while len(first := first[inner[first]]):
        covered[first] = False
        first = first + 1
    while len(back):
        covered[back] = False
        back = back[inner[back]] - 1
    return covered


def _cleaned(_key, chunk: pa.Table, answers: pa.Table, text_at: int, buckets: int, hot: tuple, length: int, gram: int) -> pa.Table:
    frame = answers.to_pandas()
    parts = []
    for row in chunk.to_pylist():
        s, covered = _covered(row, frame, buckets, hot, length, gram)
        keep = ~_whole_characters(s.data, covered)
        texts = [
            s.data[end - size : end][keep[end - size : end]].tobytes().decode("utf-8", "replace")
            for end, size in zip(s.ends.tolist(), s.sizes.tolist())
        ]
        parts.append(pa.Table.from_batches([s.rows]).add_column(text_at, "text", pa.array(texts, pa.string())))
    return pa.concat_tables(parts)


def _sorted_passes(
    rows: DataFrame, length: int, gram: int, chunk_bytes: int, bucket_bytes: int = BUCKET_BYTES
) -> tuple[DataFrame, DataFrame, dict]:
    """The chunks of the documents, the answers to all their digits, and what the steps have to know."""
    total = input_bytes(rows)
    chunks = chunked(rows, total, chunk_bytes)
    buckets = int(max(12, -(-total // bucket_bytes)))
    counted = (
        chunks.mapInPandas(partial(_count_grams, length=length, gram=gram), "gram long, n long")
        .groupBy("gram")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") > HOT_GRAM)
        .collect()  # at most one in HOT_GRAM suffixes
    )
    grams = np.array([r["gram"] for r in counted], np.int64).view(np.uint64)
    parts = np.array([-(-r["n"] // HOT_GRAM) for r in counted], np.uint64)
    hot = grams[np.argsort(grams)], parts[np.argsort(grams)]
    options = {"buckets": buckets, "hot": hot, "length": length, "gram": gram}
    # Read once by file splits: this step needs no particular distribution.
    first = materialise(
        chunks.mapInPandas(partial(_send_suffixes, **options), _MESSAGE)
        .groupBy("bucket")
        .applyInPandas(partial(_answer_suffixes, hot=hot), _MESSAGE),
        "suffix-answers",
    )
    second = materialise(
        chunks.groupBy("chunk")
        .cogroup(first.groupBy("chunk"))
        .applyInPandas(partial(_send_passages, **options), _MESSAGE)
        .groupBy("bucket")
        .applyInPandas(_answer_passages, _MESSAGE),
        "passage-answers",
    )
    answers = first.withColumn("step", F.lit(0)).unionByName(second.withColumn("step", F.lit(1)))
    return chunks, answers, options


def repeated_passages(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row.

    A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a document of
    smaller id, or earlier in the same one. Strings are judged on the input; matches do not cross documents
    and may overlap themselves. Texts shorter than ``length`` lose nothing; a NULL text is empty. A NULL id
    comes before all others. Rows that share an id count as one document in several versions: among them
    only an earlier start is earlier, so exact repetitions of a row have equal results. An empty table gives
    no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks, answers, options = _sorted_passes(rows, length, gram, chunk_bytes, BUCKET_BYTES)
    return (
        chunks.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInPandas(
            partial(_digest, **options),
            "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
        )
    )


def without_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    chunk_bytes: int = CHUNK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``; all columns and rows stay.

    As ``repeated_passages``, but a character is cut only if all its bytes are covered, so that the text
    stays valid. NULL texts become empty.
    """
    rows = docs.select(*[F.col("doc_id").cast("long").alias("doc_id") if c == "doc_id" else F.col(c) for c in docs.columns])
    chunks, answers, options = _sorted_passes(rows, length, gram, chunk_bytes, bucket_bytes)
    return (
        chunks.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(
            partial(_cleaned, text_at=rows.columns.index("text"), **options), rows.schema
        )
    )
