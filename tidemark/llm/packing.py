"""Packing into fixed windows by Karmarkar-Karp multiway differencing.

A document's tokens are cut into full windows and a rest; rests are cut into pieces. Each group of pieces is
divided into k windows of nearly equal length: every piece starts as a partial partition of its own, and the two
partial partitions of largest imbalance are merged, the long windows of one with the short ones of the
other, until one is left. If its longest window exceeds the capacity, k rises by one and the group is
divided again.

Groups are formed inside a partition, so nothing is exchanged; only the last group of a partition is small.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tidemark.llm.common import give_back, id_and_text, id_text_pairs, ship

CAPACITY = 2048
#: Rests are cut into pieces of this many tokens; smaller pieces make fuller windows and more cuts.
PIECE = 512
#: Windows that are filled together.
GROUP_WINDOWS = 256
#: Words remembered by a worker with their ids, in two halves; when one is full, it takes the place of the older one.
REMEMBERED = 1_600_000
#: Characters whose new words are tokenised together.
TEXT_BLOCK = 1 << 22
#: Pieces, and tokens where these are returned, that a task hands over at a time.
OUTPUT_ROWS, OUTPUT_TOKENS = 4096, 1 << 18

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
_FIELDS = [(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]


def difference(sizes: list[int], k: int) -> np.ndarray:
    """Window (0..k-1) of each size, by multiway differencing."""
    if k == 1 or len(sizes) == 1:
        return np.zeros(len(sizes), np.int64)
    # A partial partition: window lengths in descending order, less the shortest.
    sums: dict[int, np.ndarray] = {}
    for i, size in enumerate(sizes):
        sums[i] = np.zeros(k, np.int64)
        sums[i][0] = size
    heap = [(-size, i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    node = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        joined = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-joined, kind="stable")
        joined = joined[order]
        joined -= joined[-1]
        sums[node] = joined
        merges.append((a, b, order.astype(np.int32)))
        heapq.heappush(heap, (-int(joined[0]), node))
        node += 1
    # From the last merge down: which final window each place of a partial partition has become.
    windows = {node - 1: np.arange(k)}
    for made, (a, b, order) in zip(range(node - 1, len(sizes) - 1, -1), reversed(merges)):
        mine = np.empty(k, np.int64)
        mine[order] = windows.pop(made)
        windows[a], windows[b] = mine, mine[::-1]
    return np.array([windows[i][0] for i in range(len(sizes))])


def fill(sizes: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """Window of each size with no window above the capacity; the window count rises until that holds."""
    if not sizes:
        return np.zeros(0, np.int64)
    lengths = np.array(sizes)
    k = -(-int(lengths.sum()) // capacity)
    while True:
        windows = difference(sizes, k)
        if np.bincount(windows, lengths, k).max() <= capacity:
            return windows
        k += 1


# One printable sign for each byte, as byte-level tokenizers name them: bytes that are no printable Latin-1 signs get
# the code points from 256 on, in their order.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)]
_SIGNS = {b: 256 + i for i, b in enumerate(_HIDDEN)}
#: Letters below this code point are composed and have simple lower-case forms, but for one.
_LATIN, _NOT_SIMPLE = "\u0250", "\u0130"


def _letters(word: bytes) -> bytes | None:
    """A word of nothing but Latin letters, in lower case; None for any other word."""
    if word.isascii():
        return word if word.isalpha() else None
    text = word.decode("utf-8", "surrogatepass")
    if not text.isalpha() or max(text) >= _LATIN or _NOT_SIMPLE in text:
        return None
    return text.lower().encode()


class WordMerges:
    """The merges of a word-level BPE model for many short words at once.

    Words of one length are a matrix of ids. In every round each row merges its leftmost pair of least rank, found in a table
    with open addressing, and the matrix loses a column; rows without a pair leave.
    """

    #: Longer words are left to the tokenizer, whose time grows more slowly with the length.
    LONGEST = 48
    _NONE = np.int32(np.iinfo(np.int32).max)
    _BITS = 19

    def __init__(self, model: dict):
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        signs = [chr(_SIGNS.get(b, b)) for b in range(256)]
        self.inner = np.array([vocabulary[c] for c in signs], np.int32)
        self.last = np.array([vocabulary[c + end] for c in signs], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([vocabulary[t] for t in c], np.int64) for c in zip(*[(a, b, a + b) for a, b in pairs]))
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids of merged tokens must fit 16 bits")
        self.made = made.astype(np.int32)
        self.keys = np.zeros(1 << self._BITS, np.uint32)
        self.ranks = np.full(1 << self._BITS, self._NONE, np.int32)
        keys, ranks = (left << 16 | right).astype(np.uint32), np.arange(len(left), dtype=np.int32)
        slots, self.probes = self._slot(keys), 0
        while len(keys):  # whoever finds its slot free takes it; the last one to write stays
            free = self.ranks[slots] == self._NONE
            self.keys[slots[free]], self.ranks[slots[free]] = keys[free], ranks[free]
            rest = self.ranks[slots] != ranks
            keys, ranks, slots = keys[rest], ranks[rest], (slots[rest] + 1) & ((1 << self._BITS) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self._BITS)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        slots = self._slot(keys)
        found = self.ranks[slots]
        open_ = np.flatnonzero((self.keys[slots] != keys) & (found != self._NONE))
        found[open_] = self._NONE
        for step in range(1, self.probes):
            if not len(open_):
                break
            at = (slots[open_] + step) & ((1 << self._BITS) - 1)
            ranks, hit = self.ranks[at], self.keys[at] == keys[open_]
            found[open_[hit]] = ranks[hit]
            open_ = open_[~hit & (ranks != self._NONE)]
        return found

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word, none of which is empty or longer than LONGEST."""
        lengths = np.array([len(w) for w in words])
        order = np.argsort(lengths, kind="stable")
        out: list[bytes] = [b""] * len(words)
        edges = np.flatnonzero(np.diff(lengths[order], prepend=-1)).tolist() + [len(words)]
        for start, stop in zip(edges, edges[1:]):
            members = order[start:stop]
            raw = np.frombuffer(b"".join([words[i] for i in members.tolist()]), np.uint8).reshape(len(members), -1)
            for rows, ids in self._merge(raw):
                size, data = 4 * ids.shape[1], ids.astype("<u4").tobytes()
                for i, row in enumerate(members[rows].tolist()):
                    out[row] = data[i * size : (i + 1) * size]
        return out

    def _merge(self, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Finished rows of a matrix of bytes with their ids."""
        ids = self.inner[raw]
        ids[:, -1] = self.last[raw[:, -1]]
        rows = np.arange(len(raw))
        ranks = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(rows):
            if not ranks.shape[1]:
                yield rows, ids
                return
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            merging = best != self._NONE
            if not merging.all():
                yield rows[~merging], ids[~merging]
                rows, ids, ranks, at, best = rows[merging], ids[merging], ranks[merging], at[merging], best[merging]
            line, place = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
            ids = np.where(place <= at[:, None], ids[:, :-1], ids[:, 1:])
            ids[line, at] = self.made[best]
            ranks = np.where(place[:-1] < at[:, None], ranks[:, :-1], ranks[:, 1:])
            for shift in (-1, 0):
                near = np.flatnonzero((at + shift >= 0) & (at + shift < ranks.shape[1]))
                pair = at[near] + shift
                ranks[near, pair] = self._rank(ids[near, pair], ids[near, pair + 1])


class WordTokenizer:
    """Ids of whole texts for a tokenizer that drops white space: each distinct word is tokenised once.

    The added tokens of its file are found in the text as it stands, before it is lower-cased and split, and are one
    id each. Of the words that are left none is an added token, whatever it looks like in lower case.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED, text_block: int = TEXT_BLOCK):
        self.remembered, self.text_block = remembered, text_block
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.merges = WordMerges(json.load(file)["model"])
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or not t.special for t in added.values()):
            raise ValueError("added tokens that are not literals of the original text")
        #: By a key that no word has: the literal behind a space.
        self.added = {b" " + t.content.encode(): i.to_bytes(4, "little") for i, t in added.items()}
        literals = sorted((re.escape(k[1:]) for k in self.added), key=len, reverse=True)
        self.literal = re.compile(b"(" + b"|".join(literals) + b")") if literals else None
        self.tokenizer.encode_special_tokens = True
        self.memory: dict[bytes, bytes] = dict(self.added)
        self.older: dict[bytes, bytes] = {}

    def _words(self, text: str) -> list[bytes]:
        # bytes.lower and bytes.split know ASCII only, which the tokenizer treats alike.
        data = text.encode("utf-8", "surrogatepass")
        if self.literal is None or not self.literal.search(data):
            return data.lower().split()
        words = []
        for i, part in enumerate(self.literal.split(data)):
            words += [b" " + part] if i % 2 else part.lower().split()
        return words

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        at = 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and (not split or size < self.text_block):
                split.append(self._words(texts[at]))
                size += len(texts[at])
                at += 1
            self._learn(set().union(*split))
            for words in split:
                yield b"".join(map(self.memory.__getitem__, words))

    def _learn(self, words: set[bytes]) -> None:
        if len(self.memory) + len(words) > self.remembered // 2:
            self.older, self.memory = self.memory, dict(self.added)
        memory, older = self.memory, self.older
        fresh = words.difference(memory)
        if older:
            again = fresh.intersection(older)
            memory.update(zip(again, map(older.__getitem__, again)))
            fresh -= again
        # A word of Latin letters is one piece for the tokenizer, and one more sign behind it another: these
        # need its merges only. All other words go through it whole.
        plain: dict[bytes, bytes] = {}
        ended, others = [], set()
        for w in fresh:
            if w.isalpha():  # ASCII
                plain[w] = w
            elif (end := w[-1]) < 0x80 and not w[-1:].isalnum():
                if (letters := _letters(w[:-1])) is not None and letters:
                    ended.append((w, w[:-1]))
                    plain[w[:-1]] = letters
                    others.add(bytes((end,)))
                else:
                    others.add(w)
            elif (letters := _letters(w)) is not None:
                plain[w] = letters
            else:
                others.add(w)
        short = [w for w in plain if w not in memory and len(plain[w]) <= WordMerges.LONGEST]
        memory.update(zip(short, self.merges.encode([plain[w] for w in short])))
        rest = list((others | plain.keys()) - memory.keys())
        for start in range(0, len(rest), 1 << 14):
            part = rest[start : start + (1 << 14)]
            encoded = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            memory.update(zip(part, [array("I", e.ids).tobytes() for e in encoded]))
        for w, stem in ended:
            memory[w] = memory[stem] + memory[w[-1:]]


@lru_cache(maxsize=2)
def _loaded(path: str, remembered: int, text_block: int) -> WordTokenizer:
    return WordTokenizer(path, remembered, text_block)


class _Packer:
    def __init__(self, first_sequence: int, capacity: int, piece: int, with_ids: bool):
        self.sequence, self.capacity, self.piece, self.with_ids = first_sequence, capacity, piece, with_ids
        self.waiting: list[tuple] = []
        self.waiting_tokens = 0
        self.rows: list[tuple] = []
        self.row_tokens = 0

    def full(self) -> bool:
        return len(self.rows) >= OUTPUT_ROWS or (self.with_ids and self.row_tokens >= OUTPUT_TOKENS)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        full = total - total % self.capacity
        for start in range(0, full, self.capacity):
            self._place(doc_id, start, self.capacity, total, 0, ids)
            self.sequence += 1
        for start in range(full, total, self.piece):
            length = min(self.piece, total - start)
            self.waiting.append((doc_id, start, length, total, ids))
            self.waiting_tokens += length

    def _place(self, doc_id, start: int, length: int, total: int, offset: int, ids: bytes) -> None:
        own = ids[4 * start : 4 * (start + length)]
        self.row_tokens += length
        row = (doc_id, start, length, zlib.crc32(own), total, self.sequence, offset)
        self.rows.append((*row, np.frombuffer(own, "<u4")) if self.with_ids else row)

    def flush(self) -> None:
        """Divide what waits; pieces of a document that meet again in a window are one piece."""
        members: dict[int, list[tuple]] = {}
        for window, item in zip(fill([w[2] for w in self.waiting], self.capacity).tolist(), self.waiting):
            members.setdefault(window, []).append(item)
        for items in members.values():
            offset = 0
            doc_id, start, length, total, ids = items[0]
            for item in items[1:]:
                if item[4] is ids and item[1] == start + length:
                    length += item[2]
                    continue
                self._place(doc_id, start, length, total, offset, ids)
                offset += length
                doc_id, start, length, total, ids = item
            self._place(doc_id, start, length, total, offset, ids)
            self.sequence += 1
        self.waiting, self.waiting_tokens = [], 0

    def take(self) -> pa.RecordBatch:
        rows, self.rows, self.row_tokens = self.rows, [], 0
        columns = list(zip(*rows)) or [()] * (len(_FIELDS) + self.with_ids)
        arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS)]
        names = [n for n, _ in _FIELDS]
        if self.with_ids:
            lengths = np.array([0, *map(len, columns[-1])])
            flat = np.concatenate([np.zeros(0, "<u4"), *columns[-1]]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(flat)))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)


def _pack_batches(
    batches: Iterator[pa.RecordBatch],
    name: str,
    end_id: int,
    capacity: int,
    piece: int,
    with_ids: bool,
    remembered: int,
    text_block: int,
    forget: bool,
) -> Iterator[pa.RecordBatch]:
    if forget:  # threads of the tokenizer's own would each keep memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = _loaded(SparkFiles.get(name), remembered, text_block)
    packer = _Packer(TaskContext.get().partitionId() << 36, capacity, piece, with_ids)
    end = end_id.to_bytes(4, "little")
    for ids, texts in id_text_pairs(batches):
        for doc_id, tokens in zip(ids, tokenizer.encode(texts)):
            packer.add(doc_id, tokens + end)
            if packer.waiting_tokens >= GROUP_WINDOWS * capacity:
                packer.flush()
            if packer.full():
                yield packer.take()
    packer.flush()
    yield packer.take()
    if forget:
        del packer, tokenizer
        _loaded.cache_clear()
    give_back()


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    capacity: int = CAPACITY,
    piece: int = PIECE,
    with_ids: bool = False,
    remembered: int = REMEMBERED,
    text_block: int = TEXT_BLOCK,
    forget: bool = False,
) -> DataFrame:
    """Pieces of all documents in windows of at most ``capacity`` tokens.

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and with
    ``with_ids`` the tokens as ``ids``. A document is the ids of its whole text (``add_special_tokens=False``;
    added tokens that the text itself holds are ids of their own) and ``end_id``; NULL or empty texts are ``end_id`` alone. Every id is in one piece, and a window has no gaps.
    Long texts fill windows of their own and send only the rest to be packed. A NULL id stays NULL; repeated
    rows are packed each; an empty table gives no rows. ``sequence_id`` says which partition made the window.
    ``remembered`` words with their ids stay in a worker's memory, until the end of a task if it is to ``forget`` them and the
    tokenizer, which then runs in the task's own thread, and ``text_block`` characters are split into words at a time: all three trade time for memory, the result is
    the same.
    """
    ship(docs.sparkSession)
    docs.sparkSession.sparkContext.addFile(tokenizer)  # a vocabulary of fixed size
    options = {"name": tokenizer.rsplit("/", 1)[-1], "end_id": end_id, "capacity": capacity, "piece": piece}
    options |= {"remembered": remembered, "text_block": text_block, "forget": forget}
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return id_and_text(docs).mapInArrow(partial(_pack_batches, with_ids=with_ids, **options), schema)
