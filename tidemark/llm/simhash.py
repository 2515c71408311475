"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance d <= 2r share a variant: a value within r bits of both. Every distinct
fingerprint stands for all its variants within half the radius, variants are shuffled to where equal ones
meet, and colliding fingerprints are verified and linked.

The shuffle goes by the leading bits of the variant. The variants that keep their leading bits travel as one
row and are expanded where they arrive, so 2081 variants cost a few dozen rows; which variants meet is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import id_and_text, id_text_pairs, ship
from tidemark.llm.components import stars
from tidemark.session import materialise

BITS = 64
SHINGLE_WORDS, SEED, RADIUS = 4, 42, 4
#: Variants expanded and sorted at a time by a task.
VARIANTS = 1 << 21
#: Fingerprints of one prefix and part; a larger prefix is shared out by a hash of the variant.
PREFIX_ROWS = 1 << 16
_ARROW = pa.schema([("doc_id", pa.int64()), ("value", pa.int64())])


def fingerprint(text: str, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if it is set in over half of the hashes of all word shingles; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    hash_, n = xxhash.xxh64_intdigest, words_per_shingle
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-n].tolist()]
    counts = np.zeros(BITS, np.int64)
    total = len(starts)
    stops = (ends[n - 1 :] - 1).tolist()
    for at in range(0, total, 1 << 16):
        hashes = np.array(
            [hash_(joined[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])],
            np.uint64,
        )
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in id_text_pairs(batches):
        values = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values)], schema=_ARROW)


def _flips(bits: list[int], most: int) -> np.ndarray:
    """Masks of at most ``most`` of the given bits, as int64."""
    masks = [sum(1 << b for b in chosen) for k in range(most + 1) for chosen in combinations(bits, k)]
    return np.array(masks, np.uint64).view(np.int64)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each component of the links a-b among 0..n-1."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        root = root[root]
        if (root == before).all():
            return root


def _collide(frame: pd.DataFrame, prefix_bits: int, radius: int) -> pd.DataFrame:
    """Expand the rows of one prefix, let equal variants meet, verify, and link each fingerprint to the least of its group here."""
    values, row_of = np.unique(frame["value"].to_numpy(), return_inverse=True)
    left = frame["left"].to_numpy()
    parts, part = int(frame["parts"].iat[0] or 1), int(frame["part"].iat[0] or 0)
    low = [b for b in range(BITS - prefix_bits)]
    masks = {k: _flips(low, k) for k in np.unique(left).tolist()}
    expanded = sum(len(masks[k]) * int((left == k).sum()) for k in masks)
    slices = parts * max(1, -(-expanded // parts // VARIANTS))
    mix = np.uint64(0x9E3779B97F4A7C15)
    low_mask = np.uint64((1 << (BITS - prefix_bits)) - 1)
    a_all, b_all = [], []
    for piece in range(part, slices, parts):
        variants, owners = [], []
        for k, flips in masks.items():
            own = row_of[left == k]
            step = max(1, VARIANTS // len(flips))
            for at in range(0, len(own), step):
                v = (values[own[at : at + step], None] ^ flips).view(np.uint64) & low_mask
                o = np.broadcast_to(own[at : at + step, None], v.shape)
                if slices > 1:
                    here = ((v * mix) >> np.uint64(33)) % np.uint64(slices) == piece
                    v, o = v[here], o[here]
                variants.append(v.ravel())
                owners.append(o.ravel().astype(np.int32))
        v, o = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(v)
        v, o = v[order], o[order]
        same = np.flatnonzero(v[1:] == v[:-1])
        pairs = np.unique(np.stack([np.minimum(o[same], o[same + 1]), np.maximum(o[same], o[same + 1])]), axis=1)
        near = np.bitwise_count((values[pairs[0]] ^ values[pairs[1]]).view(np.uint64)) <= radius
        a_all.append(pairs[0][near])
        b_all.append(pairs[1][near])
    a, b = np.concatenate(a_all), np.concatenate(b_all)
    root = _roots(len(values), a, b)
    linked = np.flatnonzero(root != np.arange(len(values)))
    return pd.DataFrame({"a": values[linked], "b": values[root[linked]]})


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` that connect every two of the distinct fingerprints (column ``value``) within ``radius`` bits.

    Links within a group of colliding fingerprints are reduced to a spanning star where they are found, so
    their number stays linear and no connection is lost.
    """
    half = radius // 2 + radius % 2
    n = distinct.count()
    ball = sum(comb(BITS, k) for k in range(half + 1))
    prefix_bits = min(30, max(0, ceil(log2(max(1, n * ball / VARIANTS)))))
    masks = [
        (sum(1 << b for b in chosen), half - k)
        for k in range(min(half, prefix_bits) + 1)
        for chosen in combinations(range(prefix_bits), k)
    ]
    flips = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(left).alias("left")) for m, left in masks])
    head = F.shiftrightunsigned("value", BITS - prefix_bits) if prefix_bits else F.lit(0).cast("long")
    sent = distinct.select("value", F.explode(flips).alias("flip")).select(
        "value", head.bitwiseXOR(F.col("flip.mask")).alias("prefix"), F.col("flip.left").alias("left")
    )
    # Fingerprints that crowd under one prefix: their variants are shared out by a hash of the whole variant.
    crowded = (
        sent.groupBy("prefix")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > PREFIX_ROWS)
        .select("prefix", F.ceil(F.col("n") / PREFIX_ROWS).cast("int").alias("parts"))
    )
    shared = sent.join(crowded, "prefix", "left").select(
        "value", "prefix", "left", F.coalesce("parts", F.lit(1)).alias("parts")
    )
    shared = shared.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return shared.groupBy("prefix", "part").applyInPandas(
        partial(_collide, prefix_bits=prefix_bits, radius=radius), "a long, b long"
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    The whole text is lower-cased (A-Z) and split at ASCII white space; fingerprints come from all shingles
    of four words (repeats count), or of the whole sequence where it is shorter. Texts without words, NULL
    ones included, have fingerprint zero, which links like any other. ``component_id`` is the least doc_id
    of all that can be reached over links of at most ``radius`` differing bits. A row with a NULL id belongs
    to its component but cannot name it (a component of such rows alone has a NULL id). Repeated rows
    repeat. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    hashed = materialise(
        id_and_text(docs).mapInArrow(_fingerprints, "doc_id long, value long"), "fingerprints"
    )
    distinct = materialise(hashed.groupBy("value").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = stars(link_fingerprints(distinct.select("value"), radius))
    rooted = distinct.join(roots.select(F.col("a").alias("value"), F.col("b").alias("root")), "value", "left").select(
        "value", "first", F.coalesce("root", "value").alias("root")
    )
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root")
    return hashed.join(named.select("value", "component_id"), "value").select(
        "doc_id", F.lower(F.lpad(F.hex("value"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one of least id. All columns stay.

    Of rows that share an id one stays, the first by hash of the text. Rows with a NULL id cannot be named as
    members of a group; of those with equal texts one stays.
    """
    groups = near_duplicates(docs.filter(F.col("doc_id").isNotNull()), radius).select("doc_id", "component_id")
    return first_of_groups(docs, groups)


def first_of_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` less those that ``groups`` (``doc_id, component_id`` of every row with an id) puts behind another."""
    groups = materialise(groups, "groups")
    # Those that go are far fewer than those that stay, so the smaller list is hashed, partition by partition: the
    # plan is the same at every size, and the texts are not sorted.
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct().hint("shuffle_hash")
    named = docs.filter(F.col("doc_id").isNotNull()).join(gone, "doc_id", "left_anti").select(*docs.columns)
    if not groups.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
        marker = "_row_of_id"
        while marker in docs.columns:
            marker += "_"
        named = named.withColumn(marker, F.row_number().over(first)).filter(F.col(marker) == 1).drop(marker)
    return named.unionByName(docs.filter(F.col("doc_id").isNull()).dropDuplicates(["text"]))
