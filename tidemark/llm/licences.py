"""Licence scans: Aho-Corasick over words for notices and identifier tags, shunting-yard for licence expressions.

One automaton runs over the words of a text, lower-cased and joined by single spaces. It knows the phrases of notices and the
words of identifier tags; a tag is parsed from the place where it was found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_and_text, id_text_pairs, ship

#: The base phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notices that the method knows, as words.
NOTICES = {
    "mit license": "mit",
    "the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "apache license 2": "apache-2",
    "licensed under apache 2": "apache-2",
    "licensed under the apache license": "apache-2",
    "apache software license version 1": "apache-1",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license v3": "gpl-3",
    "gnu gpl v3": "gpl-3",
    "gplv3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license v2": "gpl-2",
    "gnu gpl v2": "gpl-2",
    "gplv2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "bsd 2 clause": "bsd-2-clause",
    "simplified bsd license": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "new bsd license": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "zlib license": "zlib",
    "do what the fuck you want to public license": "wtfpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "the unlicense": "unlicense",
    "sil open font license": "ofl",
    "python software foundation license": "psf",
    "microsoft public license": "ms-pl",
    "open database license": "odbl",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution 4": "cc-by",
    "creative commons attribution 3": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons zero": "cc0",
    "cc0 1": "cc0",
    "all rights reserved": "proprietary",
    "proprietary and confidential": "proprietary",
}
#: The tag of an identifier, its words, and the exceptions that may follow ``with``.
TAG = "spdx-license-identifier"
TAG_WORDS = "spdx license identifier"
EXCEPTIONS = {
    "classpath-exception-2.0", "gcc-exception-3.1", "llvm-exception", "autoconf-exception-3.0", "bison-exception-2.2",
    "openssl-exception", "linux-syscall-note", "font-exception-2.0", "ocaml-lgpl-linking-exception", "swift-exception",
    "libtool-exception", "qt-lgpl-exception-1.1", "u-boot-exception-2.0", "wxwindows-exception-3.1",
}
#: How much reuse a licence permits, from 0 to 1; what is not listed counts as UNLISTED.
PERMITS = {
    "cc0": 1.0, "unlicense": 1.0, "wtfpl": 1.0, "0bsd": 1.0, "mit": 1.0, "mit-0": 1.0, "isc": 1.0, "x11": 1.0, "zlib": 1.0,
    "bsd": 1.0, "bsd-2-clause": 1.0, "bsd-3-clause": 1.0, "bsl": 1.0, "ncsa": 1.0, "postgresql": 1.0, "curl": 1.0, "upl": 1.0,
    "apache-2": 0.9, "apache-1": 0.9, "psf": 0.9, "python-2": 0.9, "php-3.01": 0.9, "ms-pl": 0.9, "w3c": 0.9, "vim": 0.9,
    "bsd-4-clause": 0.9, "afl-3": 0.9, "ecl-2": 0.9, "openssl": 0.9, "cc-by": 0.9, "ofl": 0.8, "artistic": 0.7, "ruby": 0.7,
    "mpl": 0.6, "epl": 0.6, "cddl": 0.6, "ms-rl": 0.6, "odbl": 0.6, "cc-by-sa": 0.6, "lgpl": 0.5, "eupl": 0.5, "gfdl": 0.4,
    "gpl-2": 0.4, "gpl-3": 0.4, "agpl": 0.3, "sspl": 0.2, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "cc-by-nc-sa": 0.2,
    "cc-by-nc-nd": 0.1, "proprietary": 0.0,
}
UNLISTED = 0.3
#: What an exception (``with``) adds.
RELIEF = 0.1

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double"
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64())]
    + [("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
)
# Words are 0-9, a-z and everything beyond ASCII; the rest separates.
_SEPARATE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_WORD = re.compile(b"[0-9a-z\x80-\xff]+")
_AFTER_TAG = re.compile(rb"\s*:[ \t]*([^\r\n]*)")
# An identifier ends in a letter, a digit or a plus: a full stop or comma behind it ends the sentence.
_PIECE = re.compile(r"[()]|[a-z0-9](?:[a-z0-9.+:-]*[a-z0-9+])?\+?")
_BINDING = {"or": 1, "and": 2, "with": 3}
_VERSIONS = re.compile(r"(-only|-or-later|\+)$|(?<=\d)\.0(?=$|-)")


def canonical(identifier: str) -> str:
    """One label for the spellings of a licence: lower case, no ``-only``, ``-or-later``, ``+`` or ``.0``."""
    name = identifier.lower()
    while (shorter := _VERSIONS.sub("", name)) != name:
        name = shorter
    return re.sub(r"^(cc-by(-nc)?(-sa)?(-nd)?|cc0|mpl|lgpl|agpl|epl|cddl|eupl|ofl|bsl|artistic|gfdl|odbl|sspl|upl|psf)-[\d.]+$", r"\1", name)


def postfix(expression: str) -> list[str] | None:
    """The expression in postfix order by the shunting-yard method; None where it is malformed."""
    output: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for piece in _PIECE.findall(expression.lower()):
        if piece in _BINDING:
            if operand_next:
                return None
            while waiting and waiting[-1] != "(" and _BINDING[waiting[-1]] >= _BINDING[piece]:
                output.append(waiting.pop())
            waiting.append(piece)
            operand_next = True
        elif piece == "(":
            if not operand_next:
                return None
            waiting.append(piece)
        elif piece == ")":
            if operand_next:
                return None
            while waiting and waiting[-1] != "(":
                output.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        else:
            if not operand_next:
                break  # prose after the expression
            output.append(piece)
            operand_next = False
    if operand_next or "(" in waiting:
        return None
    return output + waiting[::-1]


def evaluate(expression: str) -> tuple[frozenset[str], float] | None:
    """Labels named by a licence expression, and what it permits: ``or`` lets choose, ``and`` binds to both.

    An exception adds RELIEF to what its licence permits if it is a known one.
    """
    order = postfix(expression)
    if order is None:
        return None
    stack: list[tuple[frozenset[str], float, str]] = []
    for piece in order:
        if piece not in _BINDING:
            label = canonical(piece)
            stack.append((frozenset([label]), PERMITS.get(label, UNLISTED), piece))
            continue
        (right, r, written), (left, value, _) = stack.pop(), stack.pop()
        if piece == "with":
            stack.append((left, min(1.0, value + RELIEF * (written in EXCEPTIONS)), ""))
        else:
            stack.append((left | right, max(value, r) if piece == "or" else min(value, r), ""))
    return stack[0][:2]


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *NOTICES, TAG_WORDS}:
        found.add_word(f" {phrase} ", (phrase, phrase.count(" ") + 1))
    found.make_automaton()
    return found


def _tagged(lowered: bytes, tags: list[int]) -> Iterator[str]:
    """The rest of the line behind each tag, whose first words have these numbers in ascending order."""
    if not tags:
        return
    words = enumerate(_WORD.finditer(lowered))
    number, found = next(words)
    for tag in tags:
        while number < tag:
            number, found = next(words)
        stop = found.start() + len(TAG)
        if lowered[found.start() : stop] == TAG.encode() and (line := _AFTER_TAG.match(lowered, stop)):
            yield line[1].decode("utf-8", "surrogatepass")


def scan(text: str) -> tuple:
    """Everything but the id of a result row."""
    lowered = text.encode("utf-8", "surrogatepass").lower()
    words = lowered.translate(_SEPARATE).split()
    joined = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    places, base, labels, permits, tags = [], set(), set(), [], []
    counted, word = 0, 0  # words that end before the character ``counted``
    for end, (phrase, length) in _automaton().iter(joined):
        word += joined.count(" ", counted, end)
        counted = end
        if phrase == TAG_WORDS:
            tags.append(word - length)
            continue
        if phrase in BASE_PHRASES:
            places.append(word - length)
            base.add(BASE_PHRASES[phrase])
        label = BASE_PHRASES.get(phrase) or NOTICES[phrase]
        labels.add(label)
        permits.append(PERMITS.get(label, UNLISTED))
    for expression in _tagged(lowered, tags):
        if found := evaluate(expression):
            labels |= found[0]
            permits.append(found[1])
    return (
        len(words),
        len(places),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(labels)),
        min(permits, default=0.0),
    )


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in id_text_pairs(batches):
        columns = list(zip(*map(scan, texts))) or [()] * 7
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip([ids, *columns], _ARROW)], schema=_ARROW
        )


def scan_licences(docs: DataFrame) -> DataFrame:
    """Licence notices and tags of every whole text; one row per input row, no exchange.

    ``n_base`` counts every place of a base phrase, also overlapping ones; ``first_word`` and ``last_word``
    are the smallest and largest start among them, NULL without any. ``labels`` adds what further notices
    and ``SPDX-License-Identifier`` expressions name. A malformed expression adds nothing. ``score`` is how
    much reuse the stated terms permit: the strictest of all notices and expressions, 0 where none is
    stated. A NULL text is empty (no words, empty labels); a NULL id stays NULL; repeated rows repeat.
    """
    ship(docs.sparkSession)
    return id_and_text(docs).mapInArrow(_scan_batches, SCHEMA).select(*[F.col(f.name) for f in _ARROW])
