"""Conversations rendered by a compiled template, with the spans that the model learns from, and read back again."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ship
from tidemark.llm.template import Template
from tidemark.session import materialise

#: One turn is ``### role:``, a new line, the text, ``</turn>`` and a new line; assistant texts are marked.
TURNS = (
    "{% for message in messages %}### {{ message.role | guard }}:\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | guard }}{% endgeneration %}"
    "{% else %}{{ message.text | guard }}{% endif %}</turn>\n{% endfor %}"
)
#: A conversation beyond one of these is cut by its turn numbers into parts, which are rendered in tasks of their own.
LONG_TURNS, LONG_BYTES = 2048, 1 << 24
#: Parts of a long conversation; beyond this number they grow instead.
MOST_PARTS = 4096
#: A block of output ends after so many turns or characters.
BLOCK_TURNS, BLOCK_CHARS = 256, 1 << 20

BLOCKS = "conv_id long, first long, n_turns long, total long, text string, spans array<struct<start:long,stop:long>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_BLOCKS = pa.schema(
    [("conv_id", pa.int64()), ("first", pa.int64()), ("n_turns", pa.int64()), ("total", pa.int64())]
    + [("text", pa.string()), ("spans", _SPANS)]
)
_DIGESTS = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64())]
    + [("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)

_CONTROL = re.compile(r"\\|#(?=##)|:(?=\n)|<(?=/turn>)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]++|\\.|:(?!\n))*+):\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def guard(text: str) -> str:
    """No control string (``###``, a colon before a line end, ``</turn>``) is left: a backslash parts it, and is doubled itself."""
    return _CONTROL.sub(r"\g<0>\\", text)


def unguard(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of rendered turns."""
    turns, at = [], 0
    while at < len(text):
        found = _TURN.match(text, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        turns.append((unguard(found[1]), unguard(found[2])))
        at = found.end()
    return turns


@lru_cache(maxsize=8)
def _compiled(source: str) -> Template:
    return Template(source, filters={"guard": guard})


def _render(batches: Iterator[pa.RecordBatch], source: str) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation and place become blocks; blocks carry their place, so any order would do."""
    template = _compiled(source)
    messages: list[dict] = []
    conv = first = total = None
    size = 0

    def block() -> pa.RecordBatch:
        if template.separable:
            out = template.render_part(messages, first, total)
        elif first or len(messages) < total:
            raise ValueError("this template needs whole conversations, and one is longer than LONG_TURNS or LONG_BYTES")
        else:
            out = template.render(messages)
        spans = [{"start": a, "stop": b} for a, b in out.spans]
        return pa.RecordBatch.from_pylist(
            [{"conv_id": conv, "first": first, "n_turns": len(messages), "total": total, "text": out.text, "spans": spans}],
            schema=_BLOCKS,
        )

    for batch in batches:
        names = ("conv_id", "place", "total", "role", "text")
        for c, place, n, role, text in zip(*(batch.column(name).to_pylist() for name in names)):
            follows = messages and c == conv and place == first + len(messages)
            full = template.separable and (len(messages) >= BLOCK_TURNS or size >= BLOCK_CHARS)
            if messages and (full or not follows):
                yield block()
                messages, size = [], 0
            if not messages:
                conv, first, total = c, place, n
            messages.append({"role": role, "text": text})
            size += len(text)
    if messages:
        yield block()


@dataclass
class _Digest:
    """What is known of a conversation after some of its blocks."""

    conv_id: int | None
    turns: int = 0
    chars: int = 0
    loss_chars: int = 0
    all_text: "hashlib._Hash" = field(default_factory=hashlib.sha256)
    loss_text: "hashlib._Hash" = field(default_factory=hashlib.sha256)

    def add(self, text: str, spans: list[dict]) -> None:
        for role, said in read_turns(text):
            self.turns += 1
            self.all_text.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
        for span in spans:
            learned = unguard(text[span["start"] : span["stop"]])
            self.loss_chars += len(learned)
            self.loss_text.update(learned.encode("utf-8", "surrogatepass"))
        self.chars += len(text)

    def row(self) -> dict:
        return {
            "conv_id": self.conv_id,
            "n_turns": self.turns,
            "turns_sha256": self.all_text.hexdigest(),
            "loss_chars": self.loss_chars,
            "loss_sha256": self.loss_text.hexdigest(),
            "formatted_chars": self.chars,
        }


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one conversation after the other, in order."""
    open_: _Digest | None = None
    for batch in batches:
        done = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "first", "n_turns", "total", "text", "spans")]
        for conv, first, n, total, text, spans in zip(*columns):
            if open_ is None:
                open_ = _Digest(conv)
            if open_.conv_id != conv or open_.turns != first:
                raise ValueError("blocks are not in order")
            open_.add(text, spans)
            if first + n == total:
                done.append(open_.row())
                open_ = None
        yield pa.RecordBatch.from_pylist(done, schema=_DIGESTS)


def _clean(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def _same(rows: DataFrame, other: DataFrame, *more: str) -> Column:
    condition = rows["conv_id"].eqNullSafe(other["conv_id"])
    for name in more:
        condition &= rows[name] == other[name]
    return condition


def _placed(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``conv_id, place, total, role, text`` of short conversations, and of long ones (None without any).

    A short one is ordered by one window. A long one is cut at quantiles of its turn numbers; parts are counted first,
    so that a part knows where it starts, and then ordered each by itself.
    """
    rows = _clean(rows)
    within = Window.partitionBy("conv_id")
    wanted = ["conv_id", "place", "total", "role", "text"]
    by_turn = [F.asc_nulls_first("turn"), "role", "text"]
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    long = materialise(sizes.filter((F.col("n") > LONG_TURNS) | (F.col("size") > LONG_BYTES)), "long-conversations")
    most = long.agg(F.max(F.greatest(F.ceil(F.col("n") / LONG_TURNS), F.ceil(F.col("size") / LONG_BYTES)))).first()[0]
    short = rows if most is None else rows.join(long.alias("l"), _same(rows, long), "left_anti")
    short = (
        short.withColumn("place", F.row_number().over(within.orderBy(*by_turn)).cast("long") - 1)
        .withColumn("total", F.count("*").over(within))
        .select(*wanted)
    )
    if most is None:
        return short, None
    shares = [i / min(most, MOST_PARTS) for i in range(1, min(most, MOST_PARTS))]
    ours = rows.join(long, _same(rows, long), "left_semi")
    cuts = materialise(
        ours.groupBy("conv_id").agg(F.percentile_approx("turn", F.lit(shares or [0.5]), 10_000).alias("cuts")), "turn-cuts"
    )
    part = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("turn"))), F.lit(0))
    ours = ours.join(cuts, _same(ours, cuts)).select(ours["*"], part.alias("part"))
    counted = ours.groupBy("conv_id", "part").agg(F.count("*").alias("here"))
    # One row per part, at most MOST_PARTS of a conversation.
    starts = materialise(
        counted.withColumn("start", F.sum("here").over(within.orderBy("part")) - F.col("here"))
        .withColumn("total", F.sum("here").over(within))
        .select("conv_id", "part", "start", "total"),
        "parts",
    )
    in_part = Window.partitionBy("conv_id", "part", "start", "total").orderBy(*by_turn)
    placed = ours.join(starts, _same(ours, starts, "part")).select(ours["*"], "start", "total")
    return short, placed.withColumn("place", F.col("start") + F.row_number().over(in_part) - 1).select(*wanted)


def format_conversations(rows: DataFrame, source: str = TURNS) -> DataFrame:
    """Rendered conversations in blocks: ``conv_id, first, n_turns, total, text, spans``.

    ``rows`` has ``conv_id, turn, role, text``; other columns are left behind. The blocks of a conversation, joined in order
    of ``first``, are its whole rendered form; most have one. ``spans`` are the marked parts (the loss mask), in code
    points of the block's text, end exclusive. Turns are ordered by ``turn`` (NULL first), then role, then text; repeated
    rows repeat. A NULL role or text is empty, and rows with a NULL id are one conversation with that id. An empty table
    gives no rows.

    Rows travel once. A conversation of more than LONG_TURNS turns or LONG_BYTES bytes is rendered in parts, unless the
    template needs it whole, which is then an error. Turns that share a number stay in one part.
    """
    ship(rows.sparkSession)
    short, long = _placed(rows)
    render = partial(_render, source=source)
    blocks = short.mapInArrow(render, BLOCKS)
    return blocks if long is None else blocks.unionAll(long.mapInArrow(render, BLOCKS))


def conversation_digests(rows: DataFrame, source: str = TURNS) -> DataFrame:
    """One row per conversation, read back from what ``format_conversations`` renders with a template of such turns.

    ``turns_sha256`` is over role, line end, text, line end of every turn; ``loss_sha256`` over the marked text with its
    escapes undone. Blocks of a long conversation are hashed by one task, as the digest of a whole text must be; it reads
    them one after the other and keeps none.
    """
    ship(rows.sparkSession)
    short, long = _placed(rows)
    render = partial(_render, source=source)
    digests = short.mapInArrow(render, BLOCKS).mapInArrow(_digest, DIGESTS)
    if long is None:
        return digests
    ordered = long.mapInArrow(render, BLOCKS).repartition("conv_id").sortWithinPartitions("conv_id", "first")
    return digests.unionAll(ordered.mapInArrow(_digest, DIGESTS))
