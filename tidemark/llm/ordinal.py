"""Toxicity as ordinal regression: a cumulative-link model over sparse text features.

The grades are ordered: 0 clean, 1 toxic, 2 toxic in several ways. One weight vector serves all thresholds:
P(grade > k) = sigmoid(w.x - t_k) with t_0 < t_1. The expected severity is the sum of these over k.

Features of a whole text: its distinct words, and the first four and five letters of longer ones, so that
inflected forms share evidence. Words are lower-cased (A-Z) and consist of letters, digits and everything
beyond ASCII.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import give_back, id_and_text, id_text_pairs, ship, text_slices
from tidemark.session import materialise

#: The classifier is fitted on at most this many labelled documents of each label.
SAMPLE_PER_LABEL = 5000
#: A feature enters if at least MIN_DOCS toxic documents have it, toxic ones so many times as often as clean ones, and
#: the two shares differ by MIN_DEVIATIONS standard deviations: of very many features some differ by chance.
MIN_DOCS, MIN_LIFT, MIN_DEVIATIONS = 3, 4.0, 6.0
#: A marker is a feature that toxic documents have so many times as often; a toxic document with SEVERE_MARKERS
#: different ones is of grade 2.
MARKER_LIFT, MARKER_DOCS, SEVERE_MARKERS = 50.0, 5, 3
PENALTY, ROUNDS = 2e-5, 600
#: Documents at least this likely to be above grade 0 are toxic. Clean documents stay far below (held out: under 0.05).
THRESHOLD = 0.25
PREFIXES = (4, 5)

SCHEMA = "doc_id long, expected_severity double, p_toxic double, severity int, toxic boolean"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("expected_severity", pa.float64()), ("p_toxic", pa.float64())]
    + [("severity", pa.int32()), ("toxic", pa.bool_())]
)
_SEPARATE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def features(text: str) -> set[int]:
    """Hashes of the features; words and beginnings differ in the number they are mixed with."""
    words = set(text.encode("utf-8", "surrogatepass").lower().translate(_SEPARATE).split())
    out = set(map(zlib.crc32, words))
    for n in PREFIXES:
        out.update([zlib.crc32(b, n) for b in {w[:n] for w in words if len(w) > n}])
    return out


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by feature and ascending thresholds."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def above(self, text: str) -> list[float]:
        """P(grade > k) for every k."""
        weights = self.weights
        score = sum([weights[f] for f in features(text) if f in weights]) if weights else 0.0
        return [float(1 / (1 + np.exp(-np.clip(score - t, -500, 500)))) for t in self.thresholds]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _gradient(score, grade, weight, thresholds):
    """Gradient of the mean negative log-likelihood by score and by threshold.

    With F_k = sigmoid(score - t_k), F_-1 = 1 and F_K = 0, grade g has likelihood F_(g-1) - F_g.
    """
    n, k = len(score), len(thresholds)
    above = np.ones((n, k + 2))
    above[:, 1:-1] = _sigmoid(score[:, None] - thresholds)
    above[:, -1] = 0
    slope = above * (1 - above)
    rows = np.arange(n)
    likelihood = np.maximum(above[rows, grade] - above[rows, grade + 1], 1e-12)
    by_score = -(slope[rows, grade] - slope[rows, grade + 1]) / likelihood * weight
    by_threshold = np.zeros(k + 2)
    np.add.at(by_threshold, grade, slope[rows, grade] / likelihood * weight)
    np.add.at(by_threshold, grade + 1, -slope[rows, grade + 1] / likelihood * weight)
    return by_score / n, by_threshold[1:-1] / n


def fit(documents: list[np.ndarray], toxic: np.ndarray, toxic_share: float) -> OrdinalModel:
    """Fit on arrays of feature hashes. ``toxic_share`` among all labelled documents sets the weight of both labels.

    Without documents of both labels nothing can be learned: no weights, and no document is toxic.
    """
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    if not n_toxic or not n_clean:
        return OrdinalModel({}, (50.0, 60.0))
    lengths = np.array([len(d) for d in documents])
    flat = np.concatenate(documents)
    row = np.repeat(np.arange(len(documents)), lengths)
    names, column = np.unique(flat, return_inverse=True)
    in_toxic = np.bincount(column[toxic[row]], minlength=len(names))
    in_clean = np.bincount(column[~toxic[row]], minlength=len(names))
    lift = (in_toxic + 0.1) / n_toxic / ((in_clean + 0.5) / n_clean)
    marker = (lift >= MARKER_LIFT) & (in_toxic >= MARKER_DOCS)
    markers = np.bincount(row[marker[column]], minlength=len(documents))
    grade = np.where(toxic, np.where(markers >= SEVERE_MARKERS, 2, 1), 0)

    share = (in_toxic + in_clean) / (n_toxic + n_clean)
    spread = np.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean))
    differs = in_toxic / n_toxic - in_clean / n_clean >= MIN_DEVIATIONS * np.maximum(spread, 1e-12)
    kept = (in_toxic >= MIN_DOCS) & (lift >= MIN_LIFT) & differs
    names, place = names[kept], np.cumsum(kept) - 1
    use = kept[column]
    row, column = row[use], place[column[use]]
    weight = np.where(toxic, toxic_share * len(toxic) / n_toxic, (1 - toxic_share) * len(toxic) / n_clean)

    # Accelerated proximal gradient; the thresholds move with the weights and stay in order.
    w = look = np.zeros(len(names))
    t = look_t = np.array([2.0, 4.0])
    step = 4.0 / max(1.0, float(np.bincount(row, weights=weight[row], minlength=1).max(initial=1)))
    step = max(step, 0.5)
    momentum = 1.0
    for _ in range(ROUNDS):
        score = np.bincount(row, look[column], len(documents))
        by_score, by_t = _gradient(score, grade, weight, look_t)
        moved = look - step * np.bincount(column, by_score[row], len(names))
        fresh = np.sign(moved) * np.maximum(np.abs(moved) - step * PENALTY, 0)
        fresh_t = np.sort(look_t - step * by_t)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look = fresh + (momentum - 1) / following * (fresh - w)
        look_t = np.sort(fresh_t + (momentum - 1) / following * (fresh_t - t))
        w, t, momentum = fresh, fresh_t, following
    found = np.flatnonzero(w)
    return OrdinalModel(dict(zip(names[found].tolist(), w[found].tolist())), tuple(t.tolist()))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in id_text_pairs(batches):
        packed = [np.sort(np.fromiter(features(t), np.uint32)).tobytes() for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "f"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_LABEL) -> OrdinalModel:
    """Fit on a bounded sample: of each label, the ``sample`` labelled ids of least hash.

    Labels that are NULL or have no document are left out; of several labels of one id the toxic one counts, of several
    texts of one id that whose features come last in byte order.
    """
    ship(docs.sparkSession)
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    # The share and the sample are those of the given documents, which may be a small part of all that have labels.
    here = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    known = materialise(known.join(here, "doc_id", "left_semi"), "labels")
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    parts = [known.filter(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for v in (0, 1)]
    chosen = {r["doc_id"]: r["toxic"] for r in parts[0].union(parts[1]).collect()}
    if not chosen:
        return OrdinalModel({}, (50.0, 60.0))
    picked = docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")
    rows = (
        id_and_text(docs)
        .join(F.broadcast(picked), "doc_id", "left_semi")  # at most 2 x sample ids
        .mapInArrow(_feature_batches, "doc_id long, f binary")
        .collect()
    )
    rows = sorted(dict(sorted((r["doc_id"], bytes(r["f"])) for r in rows)).items())
    if not rows:
        return OrdinalModel({}, (50.0, 60.0))
    arrays = [np.frombuffer(f, np.uint32) for _, f in rows]
    return fit(arrays, np.array([bool(chosen[i]) for i, _ in rows]), float(share))


def _score_batches(batches: Iterator[pa.RecordBatch], model: OrdinalModel, threshold: float) -> Iterator[pa.RecordBatch]:
    for ids, texts in id_text_pairs(batches):
        above = np.array([model.above(t) for t in texts]).reshape(len(texts), -1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(above.sum(1), pa.float64()),
                pa.array(above[:, 0], pa.float64()),
                pa.array((above >= 0.5).sum(1), pa.int32()),
                pa.array(above[:, 0] >= threshold, pa.bool_()),
            ],
            schema=_ARROW,
        )


def score_toxicity(docs: DataFrame, model: OrdinalModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, expected_severity, p_toxic, severity, toxic`` of every row; no exchange.

    ``expected_severity`` is the mean grade (0 to 2), ``severity`` the highest grade that is at least as
    likely reached as not. The whole text counts. A NULL or empty text has no feature and is judged by the
    thresholds alone; a NULL id stays NULL; repeated rows repeat; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    return id_and_text(docs).mapInArrow(partial(_score_batches, model=model, threshold=threshold), SCHEMA)


def _keep_batches(
    batches: Iterator[pa.RecordBatch], text_at: int, model: OrdinalModel, threshold: float
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, text_at):
            texts = part.column(text_at).fill_null("").to_pylist()
            yield part.filter(pa.array([model.above(t)[0] < threshold for t in texts], pa.bool_()))
    give_back()


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows judged toxic, all columns and rows otherwise as they are.

    Every row is judged by its whole text, whatever its id: repeated rows stay or go together, and rows with a NULL id
    are judged like others. A NULL or empty text is judged by the thresholds alone and stays.
    """
    model = train(docs, labels)
    ship(docs.sparkSession)
    keep = partial(_keep_batches, text_at=docs.columns.index("text"), model=model, threshold=threshold)
    return docs.mapInArrow(keep, docs.schema)
