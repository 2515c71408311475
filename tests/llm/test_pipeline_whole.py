"""The whole pipeline on a planted corpus, against plain versions of its stages; and the toxicity fit against a plain one."""

from __future__ import annotations

import itertools
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import ordinal

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    toxic_words = ["vilexx", "nastyzz", "brutalqq"]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    clean = {i: prose(rng.randint(100, 200)) for i in range(120)}
    for i in range(120, 150):  # near copies: one word in eighty is another, so five-word sets stay above 0.8
        words = list(clean[i - 120])
        for at in range(7, len(words), 80):
            words[at] = rng.choice(vocabulary)
        clean[i] = words
    clean[150], clean[151] = list(clean[3]), list(clean[3])
    passage = prose(60)
    for i in (40, 50, 60, 70):
        clean[i] = clean[i][:20] + passage + clean[i][20:]
    clean[152] = []
    texts = {i: " ".join(w) for i, w in clean.items()}
    for i in range(200, 290):
        words = prose(rng.randint(60, 120))
        for word in toxic_words:
            words[rng.randrange(len(words))] = word
        texts[i] = " ".join(words)
    labels = [(i, 1, int(i >= 200)) for i in texts if i % 4 != 3]
    return texts, labels


def shingle_set(text):
    words = text.split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def first_of_groups(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        union = len(sets[a] | sets[b])
        if union == 0 or 5 * len(sets[a] & sets[b]) >= 4 * union:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: t for i, t in texts.items() if find(i) == i}


def without_repeats(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        data = texts[i].encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - 99):
            part = data[at : at + 100]
            if part in seen:
                gone[at : at + 100] = True
            seen.add(part)
        out[i] = bytes(b for b, g in zip(data, gone) if not g).decode()
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    texts, labels = planted()
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t or None, "en", "web", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, texts, labels


def test_run_equals_plain_stages(spark, corpus):
    folder, texts, _ = corpus
    kept = without_repeats(first_of_groups({i: t for i, t in texts.items() if i < 200}))
    assert not {*range(120, 152)} & set(kept) and len(kept) == 121
    assert sum(len(texts[i]) - len(t) for i, t in kept.items()) > 900  # the shared passage is cut
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in kept.items()}
    got, windows = {}, {}
    for r in sorted(corpus_pipeline.run(spark, folder).collect(), key=lambda r: (r["doc_id"], r["start"])):
        ids = got.setdefault(r["doc_id"], [])
        assert r["start"] == len(ids) and r["length"] == len(r["ids"]) and r["doc_tokens"] == len(want[r["doc_id"]])
        ids += r["ids"]
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    for pieces in windows.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(pieces))]
        assert [at for at, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 2048


def test_severity_equals_a_plain_fit(spark, corpus):
    """The same objective by plain gradient descent over dense features reaches the same value, and severities that differ little."""
    folder, texts, labels = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = ordinal.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    chosen = [(i, t) for i, _, t in labels]
    toxic = np.array([bool(t) for _, t in chosen])
    have = [ordinal.features(texts[i]) for i, _ in chosen]
    names = sorted(model.weights)
    x = np.array([[float(n in f) for n in names] for f in have])
    counts = np.array([len(f & {m for m in set().union(*have) if m in model.weights}) for f in have])
    assert (counts[toxic] > 0).all() and (counts[~toxic] == 0).all()
    grade = np.where(toxic, np.where(x.sum(1) >= ordinal.SEVERE_MARKERS, 2, 1), 0)

    # P(grade > k) = s(w.x - t_k); mean negative log-likelihood plus PENALTY |w|_1, by small proximal steps from zero.
    w, t = np.zeros(len(names)), np.array([2.0, 4.0])
    s = lambda z: 1 / (1 + np.exp(-z))
    for _ in range(40_000):
        above = np.column_stack([np.ones(len(x)), s((x @ w)[:, None] - t), np.zeros(len(x))])
        slope = above * (1 - above)
        row = np.arange(len(x))
        p = np.maximum(above[row, grade] - above[row, grade + 1], 1e-12)
        by_score = -(slope[row, grade] - slope[row, grade + 1]) / p / len(x)
        by_t = np.array([((grade == k) * slope[row, k] / p - (grade + 1 == k) * slope[row, k] / p).sum() / len(x) for k in (1, 2)])
        w = w - 0.2 * (x.T @ by_score)
        w = np.sign(w) * np.maximum(np.abs(w) - 0.2 * ordinal.PENALTY, 0)
        t = t - 0.2 * by_t
    def objective(w, t):
        above = np.column_stack([np.ones(len(x)), s((x @ w)[:, None] - t), np.zeros(len(x))])
        p = above[np.arange(len(x)), grade] - above[np.arange(len(x)), grade + 1]
        return -np.log(p).mean() + ordinal.PENALTY * np.abs(w).sum()

    fitted = np.array([model.weights[n] for n in names]), np.array(model.thresholds)
    assert abs(objective(*fitted) - objective(w, t)) < 0.005
    mine = s((x @ w)[:, None] - t).sum(1)
    scored = {r["doc_id"]: r["expected_severity"] for r in ordinal.score_toxicity(docs, model).collect()}
    theirs = np.array([scored[i] for i, _ in chosen])
    assert np.corrcoef(mine, theirs)[0, 1] > 0.99 and np.abs(mine - theirs).mean() < 0.12
    assert all(scored[i] > 1.5 for i in texts if i >= 200) and all(scored[i] < 0.2 for i in texts if i < 200)
