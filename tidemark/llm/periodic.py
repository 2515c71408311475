"""Periodic runs: stretches of words that repeat with a period at least three times over.

For every scale k the hashes of all k-word windows are reduced to minimizers: places that hold the least hash of some stretch
of window starts. Within a run of smallest period q <= k two windows of k words are equal only if their distance is a multiple
of q, and the least hash of a stretch recurs q words later. So the run has two neighbouring places of the same minimizer at
distance q: a seed, which is extended word by word to both sides. A scale serves the periods from ``low`` to k =
1.5 low: with stretches of 2 low - k + 1 starts two that lie q apart fit into any run of 3 q words, so no run is missed.
Periods too short for this are found by comparing the words with those q places on, at all places at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import id_and_text, id_text_pairs, ship

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Periods up to this are searched by direct comparison.
DIRECT = 11
SCHEMA = (
    "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, "
    "strongest struct<start:long,length:long,period:long>, collapsed string"
)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("strongest", _RUN), ("collapsed", pa.string())]
)
# An odd base has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

Run = tuple[int, int, int]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Distinct places, ascending, of the least value of every stretch of ``width``; the leftmost of equal ones."""
    place = np.arange(len(values) - width + 1, dtype=np.int64)
    have, best = 1, np.arange(len(values), dtype=np.int64)
    while have < width:  # stretches of twice the width, then one overlap
        step = min(have, width - have)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        have += step
    best = best[: len(place)]
    return best[np.concatenate([[True], best[1:] != best[:-1]])] if len(best) else best


def _equal_stretch(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading words agree."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        stop = min(n, at + step)
        differ = np.flatnonzero(a[at:stop] != b[at:stop])
        if len(differ):
            return at + int(differ[0])
        at, step = stop, min(step * 4, 1 << 16)
    return n


def _primitive(words: np.ndarray, start: int, period: int) -> bool:
    """Whether no smaller period divides this one: of ``period`` words, none of its prime parts is enough."""
    rest, p = period, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            d = period // p
            if np.array_equal(words[start : start + period - d], words[start + d : start + period]):
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def _direct(words: np.ndarray, period: int) -> list[Run]:
    if len(words) <= period:
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (words[period:] == words[:-period]).view(np.int8), [0]])))
    starts, lengths = edge[::2], edge[1::2] - edge[::2] + period
    long = lengths >= max(LEAST_WORDS, LEAST_PERIODS * period)
    return [(int(s), int(n), period) for s, n in zip(starts[long], lengths[long]) if _primitive(words, int(s), period)]


def _seeded(words: np.ndarray, doc: np.ndarray, low: int, k: int) -> list[Run]:
    """Runs of periods from ``low`` to ``k``; ``doc`` numbers the documents of the words."""
    starts = len(words) - k + 1
    if starts < 2:
        return []
    raised = np.cumsum(_mixed(words.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(words)), dtype=np.uint64)
    raised = np.concatenate([np.zeros(1, np.uint64), raised])
    hashes = _mixed((raised[k:] - raised[:-k]) * _powers(_INVERSE, starts))
    places = _least_places(hashes, min(2 * low - k + 1, starts))
    places = places[doc[places] == doc[places + k - 1]]
    order = np.lexsort((places, hashes[places]))
    here, there = places[order[:-1]], places[order[1:]]
    period = there - here
    seed = (hashes[here] == hashes[there]) & (period >= low) & (period <= k) & (doc[here] == doc[there])
    runs: list[Run] = []
    reached: dict[int, int] = {}
    here, period = here[seed], period[seed]
    for i in np.lexsort((here, period)):
        p, q = int(here[i]), int(period[i])
        if p + q < reached.get(q, 0):
            continue  # within a stretch that was extended before
        after = _equal_stretch(words[p:], words[p + q :])
        before = _equal_stretch(words[:p][::-1], words[: p + q][::-1])
        start, length = p - before, before + after + q
        reached[q] = start + length
        if length >= max(LEAST_WORDS, LEAST_PERIODS * q) and _primitive(words, start, q):
            runs.append((start, length, q))
    return runs


def find_runs(words: np.ndarray, sizes: np.ndarray) -> list[list[Run]]:
    """The runs ``start, length, period`` of each of several documents, whose word numbers (non-negative) lie one after the other.

    A run is a stretch with smallest period q of at least LEAST_WORDS words and LEAST_PERIODS periods that no neighbouring
    word extends. They are ordered by start, then period.
    """
    out: list[list[Run]] = [[] for _ in sizes]
    long_enough = np.flatnonzero(sizes >= LEAST_WORDS)
    joined = _Joined(words, sizes, long_enough)
    for period in range(1, DIRECT + 1):
        joined.add(_direct(joined.words, period), out)
    low = DIRECT + 1
    while len(longer := long_enough[sizes[long_enough] >= LEAST_PERIODS * low]):
        if len(longer) < len(joined.chosen):
            joined = _Joined(words, sizes, longer)
        k = low + low // 2
        joined.add(_seeded(joined.words, joined.doc, low, k), out)
        low = k + 1
    return [sorted(set(runs), key=lambda r: (r[0], r[2])) for runs in out]


class _Joined:
    """Chosen documents one after the other, each followed by a number that occurs once."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, chosen: np.ndarray):
        n = sizes[chosen] + 1
        first = np.cumsum(sizes) - sizes
        self.chosen, self.at = chosen, np.cumsum(n) - n
        self.doc = np.repeat(np.arange(len(chosen)), n)
        inside = np.arange(int(n.sum())) - self.at[self.doc]
        ends = inside == sizes[chosen][self.doc]
        self.words = np.empty(len(inside), np.int64)
        self.words[~ends] = words[(inside + first[chosen][self.doc])[~ends]]
        self.words[ends] = words.max(initial=0) + 1 + np.arange(len(chosen))

    def add(self, runs: list[Run], out: list[list[Run]]) -> None:
        """Runs go to their documents, with places counted from the document's first word."""
        for start, length, period in runs:
            d = int(self.doc[start])
            out[int(self.chosen[d])].append((start - int(self.at[d]), length, period))


def strongest(runs: list[Run]) -> Run | None:
    """The run of most periods, compared as fractions; ties: smallest start, then period."""
    best = None
    for run in runs:  # in order of start and period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that any run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, covered in zip(words, np.cumsum(change[:-1]).tolist()) if not covered]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in id_text_pairs(batches):
        split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        numbers: dict[bytes, int] = {}
        known = numbers.setdefault
        words = np.array([known(w, len(numbers)) for document in split for w in document], np.int64)
        runs = find_runs(words, np.array([len(d) for d in split], np.int64))
        names = ("start", "length", "period")
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([len(d) for d in split], pa.int64()),
            pa.array([[dict(zip(names, r)) for r in found] for found in runs], pa.list_(_RUN)),
            pa.array([dict(zip(names, s)) if (s := strongest(found)) else None for found in runs], _RUN),
            pa.array([b" ".join(collapse(d, found)).decode("utf-8", "surrogatepass") for d, found in zip(split, runs)]),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, strongest, collapsed`` of every row; no exchange.

    Words are stretches without ASCII white space, numbered from 0. ``runs`` holds every run once, ordered by start and
    period; ``strongest`` is that of the greatest exact length / period (ties: smallest start, then period), NULL without a
    run; ``collapsed`` are the words that no run contains after its first period, joined by one space. A NULL or empty
    text has no words; a NULL id stays NULL; repeated rows repeat; an empty table gives no rows. A text is searched whole,
    whatever its length, in memory linear in it.
    """
    ship(docs.sparkSession)
    return id_and_text(docs).mapInArrow(_scan, SCHEMA)
