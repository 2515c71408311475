"""Sharding by histogram sort: exact byte counts below candidate boundaries until the splitters are good enough.

Documents are ordered by (hash of the text, doc_id), so equal texts are neighbours and even one text that
makes up a third of all rows can be cut anywhere. Each round counts, in one aggregate over the narrow key
table, the exact bytes below every probe; the probes of a splitter lie evenly inside the interval that still
holds it. When every splitter meets the tolerance the whole documents move once, to the run that holds them.

All of it is DataFrame code. What reaches the driver is ``runs x PROBES`` numbers per round at most.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

#: Probes per interval and round: one more byte of the key.
PROBES = 256
#: A run is sorted by one task. Shards above this many bytes of text consist of several runs.
RUN_BYTES = 1 << 30
MAX_RUNS_PER_SHARD = 16
ROW_OVERHEAD = 16
_KEY_DIGITS = 32
_SIGN = -(1 << 63)


def _unsigned_hex(value: Column) -> Column:
    """16 hex digits whose text order is the order of the signed numbers."""
    return F.lpad(F.hex(value.bitwiseXOR(F.lit(_SIGN))), 16, "0")


def _size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_OVERHEAD)).cast("long")


def _key(text: Column, doc_id: Column) -> Column:
    """The 128-bit sort key as 32 hex digits. A NULL id sorts first."""
    return F.concat(_unsigned_hex(F.xxhash64(F.coalesce(text, F.lit("")))), _unsigned_hex(F.coalesce(doc_id.cast("long"), F.lit(_SIGN))))


def keyed(docs: DataFrame) -> DataFrame:
    """``size`` and ``key`` of every document: all that the search for boundaries needs."""
    return docs.select(_size(F.col("text")).alias("size"), _key(F.col("text"), F.col("doc_id")).alias("key"))


@dataclass
class _Interval:
    """Keys with one prefix: bytes below it, bytes and rows in it."""

    prefix: str
    below: int
    size: int
    rows: int

    @property
    def after(self) -> str | None:
        """The first prefix beyond; None at the end of the key space."""
        following = int(self.prefix, 16) + 1
        return f"{following:0{len(self.prefix)}x}".upper() if following < 16 ** len(self.prefix) else None


def _probe(keys: DataFrame, inside: list[str]) -> dict[str, list[tuple[str, int, int]]]:
    """Bytes and rows of every non-empty cell, one digit pair finer, in the given intervals."""
    length = len(inside[0]) if inside else 0
    rows = keys.filter(F.substring("key", 1, length).isin(inside)) if inside else keys
    counts = (
        rows.groupBy(F.substring("key", 1, length + 2).alias("cell"))
        .agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
        .collect()
    )
    cells: dict[str, list[tuple[str, int, int]]] = {}
    for cell, size, n in sorted((r["cell"], r["size"], r["rows"]) for r in counts):
        cells.setdefault(cell[:length], []).append((cell, size, n))
    return cells


def find_splitters(keys: DataFrame, parts: int, tolerance: float) -> list[str]:
    """``parts - 1`` key boundaries between which the bytes are equal to within ``tolerance`` of a part.

    A boundary ``b`` has the keys ``< b`` before it. Where a single row (or rows equal in text and id) is
    larger than the tolerance, the nearer of its two sides is taken. Fewer boundaries come back only when
    there is nothing to divide.
    """
    first = _probe(keys, [])
    total = sum(size for _, size, _ in first.get("", []))
    if not total:
        return []
    slack = tolerance * total / parts
    targets = [total * k / parts for k in range(1, parts)]
    holders = {k: _Interval("", 0, total, 0) for k in range(len(targets))}
    boundaries: dict[int, str | None] = {}
    cells = first
    while holders:
        following: dict[int, _Interval] = {}
        for k, held in holders.items():
            below = held.below
            for cell, size, n in cells[held.prefix]:
                if below + size >= targets[k]:
                    break
                below += size
            found = _Interval(cell, below, size, n)
            low, high = targets[k] - below, below + size - targets[k]
            if min(low, high) <= slack or n == 1 or len(cell) >= _KEY_DIGITS:
                boundaries[k] = found.prefix if low <= high else found.after
            else:
                following[k] = found
        holders = following
        if holders:
            cells = _probe(keys, sorted({h.prefix for h in holders.values()}))
    end = "G"  # sorts after every hex digit
    return sorted((boundaries[k] or end) for k in boundaries)


def _position(key: Column, splitters: list[str], low: int, high: int) -> Column:
    """Number of splitters at or before the key, by halving: a tree of comparisons, evaluated along one path."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(key < F.lit(splitters[middle]), _position(key, splitters, low, middle)).otherwise(
        _position(key, splitters, middle + 1, high)
    )


def move_documents(
    docs: DataFrame, shards: int = 40, tolerance: float = 0.001, run_bytes: int = RUN_BYTES
) -> DataFrame:
    """Whole documents dealt to ``shards`` shards of nearly equal bytes: ``document, shard, slot``, sorted within each run.

    ``document`` is a struct of all columns as they came, so no name can clash. A document's size is the UTF-8 bytes of its
    text plus 16 (NULL text: 16). ``slot`` counts from 0 in the order of the key. Equal texts stand together and are
    divided only where a boundary falls among them, by ``doc_id``. Rows equal in text and id are interchangeable and stay
    on one side. A NULL ``doc_id`` sorts before all others. An empty table gives no rows.
    """
    keys = materialise(keyed(docs), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    per_shard = min(MAX_RUNS_PER_SHARD, max(1, -(-total // (shards * run_bytes))))
    splitters = find_splitters(keys, shards * per_shard, tolerance)
    run = _position(F.col("key"), splitters, 0, len(splitters))
    rows = docs.select(F.struct(*docs.columns).alias("document"), _key(F.col("text"), F.col("doc_id")).alias("key"))
    rows = rows.withColumn("run", run)
    within = F.row_number().over(Window.partitionBy("run").orderBy("key")) - 1
    placed = rows.withColumn("slot", within.cast("long"))
    if per_shard > 1:
        # One number per run (at most shards x MAX_RUNS_PER_SHARD): the slots that earlier runs of its shard take.
        counted = bisect_counts(keys.select(run.alias("run")), per_shard)
        offsets = keys.sparkSession.createDataFrame(counted, "run int, before long")
        placed = placed.join(F.broadcast(offsets), "run").withColumn("slot", F.col("slot") + F.col("before"))
    return placed.select("document", F.floor(F.col("run") / per_shard).cast("int").alias("shard"), "slot")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The moved documents as Parquet, a folder for each shard, with their slots; a shard of several runs has several files."""
    moved = move_documents(docs, **options)
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    columns = [F.col("document")[c].alias(c) for c in names]
    moved.select(*columns, "shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 40, **options) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document, read from it where it was moved to.

    ``size`` and ``text_crc32`` are of the moved text (NULL: of an empty one). ``grown_shard`` is NULL under this law (``bytes``).
    """
    text = F.col("document.text")
    return move_documents(docs, shards, **options).select(
        F.col("document.doc_id").cast("long").alias("doc_id"),
        _size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def bisect_counts(placed: DataFrame, per_shard: int) -> list[tuple[int, int]]:
    """(run, rows of the earlier runs of the same shard)."""
    rows = sorted((r["run"], r["n"]) for r in placed.groupBy("run").agg(F.count("*").alias("n")).collect())
    runs = [run for run, _ in rows]
    out = []
    for i, (run, _) in enumerate(rows):
        start = bisect_right(runs, (run // per_shard) * per_shard - 1)
        out.append((run, sum(n for _, n in rows[start:i])))
    return out
