"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least 0.8. No such pair is missed.

First the SimHash fingerprints of the sets meet by their balls (``simhash.link_fingerprints``), which finds most copies that
differ little; then a prefix filter finds the rest, of which a ball that small misses many. Every pair is verified.

A set shares at least 0.8 of itself with every near copy, so of two near copies the first 0.2 + 1 shingles of each, in
one fixed order of all shingles, have one in common (prefix filter). All they share stands from the first common one
on, so two sets meet by a shingle only if enough of both is left from there (positional filter). Each pair is
verified on the whole sets, unless parity bitmaps of the two already bound it below 0.8. Shingles that are frequent
in a sample come last in the order, the most frequent at the end; the sample decides what a run costs, not what it finds.

Sets first meet the smallest set of their shingle; then, where a shingle joins sets of several components, a few others of
it, again as long as that links many; then those that are still in different components meet. A large group of copies
thus costs a few pairs for each of its sets, also where only some of the pairs in it are similar.

A SimHash ball that holds all such pairs is out of reach: at similarity 0.8 some 10 of 64 bits differ in the mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import give_back, id_and_text, id_text_pairs, ship
from tidemark.llm.components import stars
from tidemark.llm.simhash import RADIUS, first_of_groups, link_fingerprints
from tidemark.session import materialise

SHINGLE_WORDS, SEED = 5, 42
#: The least similarity, as a fraction of whole numbers.
SIMILAR, OF = 4, 5
#: Least documents of the sample for frequent shingles, its share of all (one in so many) where that is more, documents of
#: it that make a shingle frequent, and how many are kept.
SAMPLE, SHARE, FREQUENT, MOST_FREQUENT = 4096, 16, 4, 1 << 16
#: Sets of a shingle that the others meet in a round, most rounds, and the rows for each link found that end them.
CHOSEN, ROUNDS, SCARCE = 8, 4, 16
#: Least bits of the parity bitmap of a set, 64-bit words that it is folded to for a first look, and bits of the filter for the ids of the texts that are read as sets.
PARITY_BITS, FOLDED, ID_BITS = 1024, 16, 1 << 24


def shingles(text: str, words_per_shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct hashes of all word shingles, ascending; of the whole sequence where it is shorter; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined, hash_, n = b" ".join(words), xxhash.xxh64_intdigest, words_per_shingle
    if len(words) <= n:
        return np.array([hash_(joined, SEED)], np.uint64).view(np.int64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops = [0, *ends[:-n].tolist()], (ends[n - 1 :] - 1).tolist()
    return np.unique(np.array([hash_(joined[s:e], SEED) for s, e in zip(starts, stops)], np.uint64).view(np.int64))


def _name(own: np.ndarray) -> int:
    """One number for a set; equal sets have equal ones."""
    return int(np.array([xxhash.xxh64_intdigest(own.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def _fingerprint(own: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes of the set."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(own), 1 << 16):
        part = own[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(own), bitorder="little").view(np.int64)[0])


def _parity(own: np.ndarray) -> bytes:
    """A bit is 1 if an odd number of the set falls on it: two sets differ in at least as many members as bits.

    Twice as many bits as members or more, a power of two; a longer bitmap folded in half is the shorter one.
    """
    n = max(PARITY_BITS, 1 << (2 * len(own)).bit_length())
    counts = np.bincount((own.view(np.uint64) >> np.uint64(20)).astype(np.int64) & (n - 1), minlength=n)
    return np.packbits(counts & 1).tobytes()


def _folded(bits: bytes) -> list[int]:
    """The bitmap at a length of ``FOLDED`` words."""
    x = np.frombuffer(bits, np.int64)
    while len(x) > FOLDED:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tolist()


def _differ(a: bytes, b: bytes) -> int:
    """Differing bits of two bitmaps, at the length of the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _prefixes(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``frequent`` from the most frequent on."""
    by_name = np.argsort(frequent)
    names_of_frequent = frequent[by_name]
    for ids, texts in id_text_pairs(batches):
        names, sizes, prefixes, bits, prints, commons = [], [], [], [], [], []
        for text in texts:
            own = shingles(text)
            size = len(own)
            at = np.searchsorted(names_of_frequent, own)
            common = at < len(frequent)
            common[common] = names_of_frequent[at[common]] == own[common]
            last = own[common][np.argsort(-by_name[at[common]])]
            own_order = np.concatenate([own[~common], last])
            names.append(_name(own))
            sizes.append(size)
            bits.append(_parity(own))
            prints.append(_fingerprint(own))
            prefixes.append(own_order[: size - -(-SIMILAR * size // OF) + 1])
            commons.append(max(0, len(prefixes[-1]) - (size - int(common.sum()))))
        offsets = np.cumsum([0, *map(len, prefixes)])
        flat = np.concatenate([np.zeros(0, np.int64), *prefixes])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(names, pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(bits, pa.binary()),
                pa.array([_folded(b) for b in bits], pa.list_(pa.int64())),
                pa.array(prints, pa.int64()),
                pa.array(commons, pa.int32()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)),
            ],
            ["doc_id", "value", "size", "bits", "folded", "print", "common", "prefix"],
        )
    give_back()


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in id_text_pairs(batches):
        for text in texts:
            yield pa.RecordBatch.from_arrays([pa.array(shingles(text))], ["token"])
    give_back()


def _sets(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The sets of the texts whose ``place`` is set in the bits ``wanted``."""
    for batch in batches:
        place = batch.column("place").to_numpy()
        for _, texts in id_text_pairs([batch.filter(pa.array(wanted[place >> 3] >> (place & 7) & 1 == 1))]):
            owns = [shingles(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_name(o) for o in owns], pa.int64()), pa.array([o.tobytes() for o in owns], pa.binary())],
                ["value", "own"],
            )
    give_back()


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that sizes and bitmaps do not rule out: the sets share at most half of (both sizes less differing bits)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        pairs = zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())
        differ = np.array([_differ(a, b) for a, b in pairs])
        both = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()
        shared = (both - differ) // 2
        near = pa.array(OF * shared >= SIMILAR * (both - shared))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in ("a", "b")], ["a", "b"])
    give_back()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, near = batch.column("a"), batch.column("b"), []
        for x, y in zip(batch.column("own_a"), batch.column("own_b")):
            x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            near.append(OF * shared >= SIMILAR * (len(x) + len(y) - shared))
        near = pa.array(near, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(near), b.filter(near)], ["a", "b"])
    give_back()


def _frequent(docs: DataFrame) -> np.ndarray:
    """Shingles of many documents of a sample, the most frequent first; their number is bounded."""
    every = max(1, min(SHARE, docs.count() // SAMPLE))
    sample = id_and_text(docs).filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    rows = (
        sample.mapInArrow(_tokens, "token long")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= FREQUENT)
        .orderBy(F.desc("n"), "token")
        .limit(MOST_FREQUENT)
        .collect()
    )
    return np.array([r["token"] for r in rows], np.int64)


def _near(pairs: DataFrame, distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` of sets that are similar; only texts that occur in a possible pair are read as sets."""

    def side(name: str) -> DataFrame:
        return distinct.select(
            F.col("value").alias(name), F.col("size").alias(f"size_{name}"), F.col("bits").alias(f"bits_{name}")
        )

    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    bounded = pairs.join(side("a"), "a").join(side("b"), "b")
    pairs = materialise(bounded.mapInArrow(_possible, "a long, b long"), "pairs")
    named = pairs.select(F.col("a").alias("value")).union(pairs.select("b")).distinct()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS)).alias("place")
    words = (
        distinct.join(named, "value", "left_semi")
        .select(F.col("first").alias("doc_id"))
        .select(place)
        .groupBy(F.expr("place div 32").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(place % 32 as int)))").alias("bits"))
        .collect()  # at most ID_BITS / 32 numbers
    )
    wanted = np.zeros(ID_BITS // 32, "<u4")
    wanted[[r["word"] for r in words]] = [r["bits"] for r in words]
    texts = id_and_text(docs).select("doc_id", "text", place)
    sets = texts.mapInArrow(partial(_sets, wanted=wanted.view(np.uint8)), "value long, own binary")
    sets = materialise(sets.dropDuplicates(["value"]), "sets")
    both = pairs.join(sets.select(F.col("value").alias("a"), F.col("own").alias("own_a")), "a").join(
        sets.select(F.col("value").alias("b"), F.col("own").alias("own_b")), "b"
    )
    return materialise(both.select("a", "b", "own_a", "own_b").mapInArrow(_verified, "a long, b long"), "near")


def _enough(size_a: str, at_a: str, size_b: str, at_b: str) -> Column:
    """Sets whose first common shingle stands at these places can be similar: what is left of both would be enough to share.

    This bounds the sizes too.
    """
    left = F.least(F.col(size_a) - F.col(at_a), F.col(size_b) - F.col(at_b))
    return (SIMILAR + OF) * left >= SIMILAR * (F.col(size_a) + F.col(size_b))


def _roots(links: DataFrame) -> DataFrame:
    """``value, root`` of the links that ``stars`` leaves."""
    return links.select(F.col("a").alias("value"), F.col("b").alias("root"))


def _apart(rest: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with the root of their component, of the shingles that several components share."""
    rest = rest.join(roots, "value", "left").select("token", "value", "size", "at", F.coalesce("root", "value").alias("root"))
    mixed = rest.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    return rest.join(mixed.select("token"), "token", "left_semi")


def _meeting_some(rest: DataFrame, turn: int) -> DataFrame:
    """Pairs ``a, b`` of some sets of each shingle, chosen by hashes, and those of other components: ``CHOSEN`` for each row at most."""
    columns = ("value", "size", "at", "root")
    some = [F.min_by(F.struct(*columns), F.xxhash64("value", F.lit(turn * CHOSEN + i))) for i in range(CHOSEN)]
    led_by = rest.groupBy("token").agg(F.array_distinct(F.array(*some)).alias("some"))
    led_by = led_by.select("token", F.explode("some").alias("one")).select("token", *[F.col(f"one.{c}").alias(f"{c}_b") for c in columns])
    met = rest.join(led_by, "token").filter((F.col("root") != F.col("root_b")) & _enough("size", "at", "size_b", "at_b"))
    return met.select(F.col("value").alias("a"), F.col("value_b").alias("b"))


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, component_id`` for every row with an id.

    Words are taken as in ``simhash.near_duplicates``; shingles are five words (the whole sequence of a shorter
    text) and count once. Rows are linked if the Jaccard similarity of their sets is at least 0.8; texts without
    words are alike. ``component_id`` is the least doc_id that can be reached over links. An empty table gives no
    rows.
    """
    docs = docs.filter(F.col("doc_id").isNotNull())
    ship(docs.sparkSession)
    options = {"frequent": _frequent(docs)}
    hashed = materialise(
        id_and_text(docs).mapInArrow(
            partial(_prefixes, **options), "doc_id long, value long, size long, bits binary, folded array<long>, print long, common int, prefix array<long>"
        ),
        "prefixes",
    )
    distinct = materialise(
        hashed.groupBy("value").agg(
            F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("size", "bits", "folded", "print")]
        ),
        "distinct-sets",
    )
    # Sets of one fingerprint meet the smallest of them, and these meet by the balls of their fingerprints.
    prints = materialise(distinct.groupBy("print").agg(F.min_by("value", F.struct("size", "value")).alias("leader")), "prints")
    met = link_fingerprints(prints.select(F.col("print").alias("value")), RADIUS)
    for side in ("a", "b"):
        met = met.join(prints.select(F.col("print").alias(side), F.col("leader").alias(f"set_{side}")), side)
    alike = distinct.select("print", "value").join(prints, "print").filter("value <> leader")
    balls = met.select(F.col("set_a").alias("a"), F.col("set_b").alias("b")).union(alike.select("leader", "value"))

    # Equal sets have equal prefixes: one of each is enough. ``common``: so many of a prefix, its last, are frequent ones.
    at, length = F.posexplode("prefix").alias("at", "token"), F.size("prefix").alias("n_prefix")
    tokens = hashed.select("value", "size", "common", "prefix").dropDuplicates(["value"])
    tokens = tokens.select("value", "size", "common", length, at).select(
        "value", "size", "at", "token", (F.col("at") >= F.col("n_prefix") - F.col("common")).alias("frequent")
    )
    # Of most shingles a single set has one: one exchange, to which each brings few rows. The frequent ones are at most
    # MOST_FREQUENT and are added up before they are sent, so that their rows are not.
    meeting = Window.partitionBy("token")
    leader = F.min(F.struct("size", "value", "at"))
    rare = tokens.filter(~F.col("frequent")).withColumn("n", F.count("*").over(meeting)).withColumn("leader", leader.over(meeting))
    frequent = tokens.filter("frequent")
    led_by = frequent.groupBy("token").agg(F.count("*").alias("n"), leader.alias("leader"))
    frequent = frequent.join(F.broadcast(led_by), "token")
    columns = ["token", "value", "size", "at", "n"]
    columns += [F.col(f"leader.{c}").alias(name) for c, name in (("value", "leader"), ("size", "least"), ("at", "leader_at"))]
    shared = rare.filter("n > 1").select(*columns).union(frequent.filter("n > 1").select(*columns))
    shared = materialise(shared, "shared")
    led = shared.filter((F.col("value") != F.col("leader")) & _enough("size", "at", "least", "leader_at"))
    led = led.select(F.col("leader").alias("a"), F.col("value").alias("b"))
    links = stars(_near(balls.union(led), distinct, docs))

    # Sets of different components that share a shingle and have not met. While that links many, they first meet some of them
    # by each shingle, others in each round, so that a large group grows together before its members meet each other.
    rest = shared.filter((F.col("n") > 2) & (F.col("value") != F.col("leader"))).select("token", "value", "size", "at")
    rest = materialise(_apart(rest, _roots(links)), "rest")
    for turn in range(ROUNDS):
        found = _near(_meeting_some(rest, turn), distinct, docs)
        n = found.count()
        if n:
            links = stars(links.union(found))
            rest = materialise(_apart(rest.drop("root"), _roots(links)), "rest")
        if SCARCE * n < rest.count():
            break
    words = [f"bits_{i}" for i in range(FOLDED)]
    rest = rest.join(distinct.select("value", *[F.col("folded")[i].alias(c) for i, c in enumerate(words)]), "value")
    other = rest.select("token", *[F.col(c).alias(f"{c}_b") for c in ("value", "size", "at", "root", *words)])
    differ = reduce(add, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in words])
    crossed = rest.join(other, "token").filter(
        (F.col("value") < F.col("value_b"))
        & (F.col("root") != F.col("root_b"))
        & _enough("size", "at", "size_b", "at_b")
        & ((SIMILAR + OF) * differ <= (OF - SIMILAR) * (F.col("size") + F.col("size_b")))
    )
    last = _near(crossed.select(F.col("value").alias("a"), F.col("value_b").alias("b")), distinct, docs)
    if not last.isEmpty():
        links = stars(links.union(last))

    rooted = distinct.join(_roots(links), "value", "left").select("value", "first", F.coalesce("root", "value").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root")
    return hashed.select("doc_id", "value").join(named.select("value", "component_id"), "value").select(
        "doc_id", "component_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one of least id. All columns stay.

    Rows that share an id or have none are treated as in ``simhash.one_of_each``.
    """
    return first_of_groups(docs, near_copies(docs))
