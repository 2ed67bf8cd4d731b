"""License scans: Aho-Corasick over words finds notices and identifier tags, shunting-yard evaluates what a tag says.

A text's words are runs of ASCII letters and digits (in lower case) and of characters beyond ASCII. One automaton holds all
phrases; it reads a text's words joined by single spaces, so a phrase is found wherever its words stand consecutively,
whatever stands between them. Three kinds of phrase are searched:

* base phrases (``BASE``): every place counts, overlapping ones too;
* notices (``NOTICES``): a notice within a longer notice gives way to it;
* tags (``TAGS``): if a colon or an equals sign follows, the rest of the line is read as an expression of licence ids,
  ``and``, ``or``, ``with`` and parentheses. The longest start of the line that is an expression counts: reading stops at an
  id nobody knows, at two ids without an operator and at a closing parenthesis too many; open parentheses end with it.
  ``with`` binds closest, then ``and``, then ``or``.

An expression has a freedom from 0 to 1: of ``or`` the largest, as the licensee may choose, of ``and`` the least, as both
bind, and ``with`` lifts its licence halfway to the next freer class. All expressions and notices of a text bind
together, so the text's ``freedom`` is their least; null if there are none. ``score`` is how sure the finding is: one less the
product of the doubts that its different phrases and expressions leave.

Nulls: a null text is an empty one (no words, no places, score 0); a null ``doc_id`` is carried. Repeated rows are each
returned, with equal results. Very long texts come alone in their batch. An empty table gives an empty table. Only the
text and the columns in ``keep`` are read, so other columns cannot clash. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.words import text_slices

#: Phrases and labels of the base scan.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Classes of licences, freest first, and the freedom each leaves.
CLASSES = {"public": 1.0, "permissive": 0.8, "weak copyleft": 0.6, "copyleft": 0.4, "network copyleft": 0.3, "no trade": 0.2, "no change": 0.1, "closed": 0.0}


class Licence(NamedTuple):
    kind: str
    #: Ids in expressions, in lower case.
    ids: tuple[str, ...]
    #: Phrases of words that announce it.
    notices: tuple[str, ...] = ()


LICENCES = {
    "mit": Licence("permissive", ("mit",), ("mit license", "licensed under mit", "permission is hereby granted free of charge to any person obtaining a copy")),
    "apache-2": Licence("permissive", ("apache-2.0", "apache-2"), ("apache license version 2 0", "apache license 2 0", "apache 2 0 license")),
    "bsd-2": Licence("permissive", ("bsd-2-clause",), ("bsd 2 clause license", "simplified bsd license")),
    "bsd-3": Licence("permissive", ("bsd-3-clause",), ("bsd 3 clause license", "new bsd license")),
    "bsd": Licence("permissive", ("bsd",), ("bsd license", "redistribution and use in source and binary forms with or without modification are permitted")),
    "isc": Licence("permissive", ("isc",), ("isc license",)),
    "zlib": Licence("permissive", ("zlib",), ("zlib license",)),
    "bsl-1": Licence("permissive", ("bsl-1.0",), ("boost software license",)),
    "cc0": Licence("public", ("cc0-1.0", "cc0"), ("cc0 1 0 universal", "cc0 1 0")),
    "unlicense": Licence("public", ("unlicense",), ("free and unencumbered software released into the public domain",)),
    "cc-by": Licence("permissive", ("cc-by-4.0", "cc-by-3.0", "cc-by"), ("cc by 4 0", "cc by 3 0", "creative commons attribution 4 0")),
    "cc-by-sa": Licence("weak copyleft", ("cc-by-sa-4.0", "cc-by-sa-3.0", "cc-by-sa"), ("cc by sa", "creative commons attribution sharealike")),
    "cc-by-nc": Licence("no trade", ("cc-by-nc-4.0", "cc-by-nc-3.0", "cc-by-nc"), ("cc by nc", "creative commons attribution noncommercial")),
    "cc-by-nc-sa": Licence("no trade", ("cc-by-nc-sa-4.0", "cc-by-nc-sa"), ("cc by nc sa",)),
    "cc-by-nd": Licence("no change", ("cc-by-nd-4.0", "cc-by-nd"), ("cc by nd",)),
    "cc-by-nc-nd": Licence("no change", ("cc-by-nc-nd-4.0", "cc-by-nc-nd"), ("cc by nc nd",)),
    "mpl-2": Licence("weak copyleft", ("mpl-2.0",), ("mozilla public license version 2", "mozilla public license 2 0")),
    "epl-2": Licence("weak copyleft", ("epl-2.0",), ("eclipse public license version 2", "eclipse public license 2 0")),
    "lgpl-2.1": Licence("weak copyleft", ("lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later"), ("gnu lesser general public license version 2 1",)),
    "lgpl-3": Licence("weak copyleft", ("lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later"), ("gnu lesser general public license version 3",)),
    "gpl-2": Licence("copyleft", ("gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later"), ("gnu general public license version 2", "gnu gpl v2")),
    "gpl-3": Licence("copyleft", ("gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later"), ("gnu general public license version 3", "gnu gpl v3")),
    "gpl": Licence("copyleft", ("gpl",), ("gnu general public license",)),
    "agpl-3": Licence("network copyleft", ("agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later"), ("gnu affero general public license version 3",)),
    "proprietary": Licence("closed", ("proprietary", "licenseref-proprietary"), ("proprietary and confidential",)),
}

EXCEPTIONS = ("classpath-exception-2.0", "llvm-exception", "gcc-exception-3.1", "autoconf-exception-3.0", "openssl-exception", "linux-syscall-note", "font-exception-2.0")
LABEL_OF = {name: label for label, licence in LICENCES.items() for name in licence.ids}
NOTICES = {phrase: label for label, licence in LICENCES.items() for phrase in licence.notices}

#: Words of a tag, and the doubt that an expression after it leaves.
TAGS = {"spdx license identifier": 0.02, "license": 0.2, "licence": 0.2}
#: The doubt that a notice leaves.
NOTICE_DOUBT = 0.15

#: Letters of A-Z in lower case, and a space for what is no part of a word.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c > 0x7F or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_AFTER_TAG = re.compile(r"[\x20\t\"']*[:=]([^\r\n]*)")
_TOKEN = re.compile(r"[\x20\t\"']*([()]|[A-Za-z0-9][A-Za-z0-9.+-]*)")
_BINDS = {"or": 1, "and": 2, "with": 3}


def tokens(line: str) -> list[str]:
    """Parentheses, operators and known names at the start of a line, in lower case, up to the first thing that is none."""
    out: list[str] = []
    at = 0
    while found := _TOKEN.match(line, at):
        token = found[1].lower().rstrip(".")
        token = token.removesuffix("+") if token.removesuffix("+") in LABEL_OF else token
        if token not in _BINDS and token not in "()" and token not in LABEL_OF and token not in EXCEPTIONS:
            break
        out.append(token)
        at = found.end()
    return out


def postfix(parts: list[str]) -> list[str]:
    """The longest expression at the start of ``parts`` in postfix order, by shunting-yard; empty if there is none.

    An operator waits until an operand follows it, so a trailing one is left out.
    """
    out: list[str] = []
    waiting: list[str] = []
    pending: list[str] = []  # an operator and open parentheses whose operand has not come yet
    operand_next = True
    for part in parts:
        if operand_next:
            exception = part in EXCEPTIONS
            if part == "(" and not (pending and "with" in pending):
                pending.append(part)
            elif (part in LABEL_OF or exception) and exception == (pending == ["with"]):
                for held in pending:
                    while held in _BINDS and waiting and _BINDS.get(waiting[-1], 0) >= _BINDS[held]:
                        out.append(waiting.pop())
                    waiting.append(held)
                pending.clear()
                out.append(part)
                operand_next = False
            else:
                break
        elif part in _BINDS and not (part == "with" and out[-1] not in LABEL_OF):
            pending.append(part)
            operand_next = True
        elif part == ")" and "(" in waiting:
            while (top := waiting.pop()) != "(":
                out.append(top)
        else:
            break
    return out + [part for part in reversed(waiting) if part != "("]


def evaluate(ordered: list[str], leaf: Callable, both: dict[str, Callable]):
    """The value of a postfix expression: ``leaf`` of each name, combined by the operators in ``both``."""
    held: list = []
    for part in ordered:
        if part in both:
            right, left = held.pop(), held.pop()
            held.append(both[part](left, right))
        else:
            held.append(leaf(part))
    return held[0]


def _lifted(freedom: float) -> float:
    return (freedom + min((f for f in CLASSES.values() if f > freedom), default=freedom)) / 2


def _freedom_of(name: str) -> float:
    return CLASSES[LICENCES[LABEL_OF[name]].kind] if name in LABEL_OF else 0.0


def freedom(ordered: list[str]) -> float:
    return evaluate(ordered, _freedom_of, {"or": max, "and": min, "with": lambda licence, _: _lifted(licence)})


def canonical(ordered: list[str]) -> str:
    """The expression in one form: labels, operators, and parentheses only where an ``or`` stands within an ``and``."""

    def joined(operator: str) -> Callable:
        def text(left: tuple[str, int], right: tuple[str, int]) -> tuple[str, int]:
            own = _BINDS[operator]
            shown = [f"({t})" if 0 < level < own else t for t, level in (left, right)]
            return f" {operator} ".join(shown), own

        return text

    return evaluate(ordered, lambda name: (LABEL_OF.get(name, name), 0), {o: joined(o) for o in _BINDS})[0]


class _Phrase(NamedTuple):
    words: int
    base: str | None
    notice: str | None
    tag: str | None


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, **TAGS}:
        tag = phrase if phrase in TAGS else None
        found.add_word(f" {phrase} ", (phrase, _Phrase(phrase.count(" ") + 1, BASE.get(phrase), NOTICES.get(phrase), tag)))
    found.make_automaton()
    return found


def _outermost(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Notices (first word, end, phrase) that do not lie within another one."""
    out: list[tuple[int, int, str]] = []
    end = -1
    for span in sorted(found, key=lambda s: (s[0], -s[1])):
        if span[1] > end:
            out.append(span)
            end = span[1]
    return out


def _word_ends(raw: bytes) -> np.ndarray:
    """The byte after each word of a text whose other bytes are spaces."""
    inside = np.frombuffer(raw + b" ", np.uint8) != 32
    return np.flatnonzero(inside[:-1] & ~inside[1:]) + 1


def scan_text(text: str) -> tuple:
    """The row of one text: see ``scan``."""
    raw = text.encode()
    spaced = raw.translate(_TO_WORDS)
    parts = spaced.split()
    line = f" {b' '.join(parts).decode()} "
    places: list[int] = []
    base, doubts, labels, expressions, bounds = set(), {}, set(), [], []
    notices, tags = [], []
    at = word = 0
    for end, (phrase, kind) in _automaton().iter(line):
        word += line.count(" ", at, end)
        at = end
        first = word - kind.words
        if kind.base:
            places.append(first)
            base.add(kind.base)
            doubts[phrase] = NOTICE_DOUBT
            bounds.append(CLASSES[LICENCES[kind.base].kind])
        if kind.notice:
            notices.append((first, word, phrase))
        if kind.tag:
            tags.append((word - 1, phrase))
    for _, _, phrase in _outermost(notices):
        labels.add(NOTICES[phrase])
        doubts[phrase] = NOTICE_DOUBT
        bounds.append(CLASSES[LICENCES[NOTICES[phrase]].kind])
    ends = _word_ends(spaced) if tags else None
    for last, phrase in tags:
        # The rest of the line only: a tag's line may be as long as the text, so it is cut before it is decoded.
        stop = raw.find(b"\n", int(ends[last]))
        rest = raw[int(ends[last]) : stop if stop >= 0 else len(raw)] if _tagged(raw, int(ends[last])) else b""
        ordered = postfix(tokens(found[1])) if rest and (found := _AFTER_TAG.match(rest.decode())) else []
        if ordered:
            labels.update(LABEL_OF[name] for name in ordered if name in LABEL_OF)
            shown = canonical(ordered)
            expressions.append(shown)
            doubts[shown] = min(doubts.get(shown, 1), TAGS[phrase])
            bounds.append(freedom(ordered))
    doubt = 1.0
    for phrase in sorted(doubts):
        doubt *= doubts[phrase]
    labels |= base
    return (
        len(parts), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
        ",".join(sorted(labels)), 1 - doubt, min(bounds, default=None), sorted(set(expressions)),
    )


def _tagged(raw: bytes, at: int) -> bool:
    """Does a colon or an equals sign follow, after blanks and quotes?"""
    while raw[at : at + 1] in (b" ", b"\t", b'"', b"'"):
        at += 1
    return raw[at : at + 1] in (b":", b"=")


_FOUND = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, freedom double, expressions array<string>"
_TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] * 2 + [pa.list_(pa.string())]


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, and for each whole text:

    ``n_words``; ``n_base``, ``first_word``, ``last_word`` of the base places (words from 0, null if none); ``base_labels`` and
    ``labels`` (distinct, sorted, comma-joined); ``score``; ``freedom``; ``expressions`` in canonical form.
    """
    rows = docs.select(*keep, F.col("text"))
    kept = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in kept] + [part.split()[0] for part in _FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = zip(*(scan_text(text.as_py()) for text in batch.column("text")))
            columns = [pa.array(list(values), kind) for values, kind in zip(found, _TYPES)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], names=names)

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), _FOUND]))
