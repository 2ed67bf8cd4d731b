"""Secrets in whole texts, with weak parts linked into credentials. DataFrame functions only.

Base kinds are found by a pattern each, leftmost and non-overlapping: ``assign`` (a named value),
``access`` (an access key id) and ``hex`` (a long hexadecimal run). Weak parts are an ``ident`` (a user or
client name), a ``secret`` (a random-looking run, however long) and an endpoint (a whole URL). An identifier is an access
key id or an ident. A weak secret is reported only if an identifier or an endpoint lies in its scope, an
ident only if a weak secret or an assigned value does. The scope of a part is its text from
``SCOPE`` code points before it to ``SCOPE`` after it, without the part itself: a part that overlaps a candidate does not complete it.

The link is an interval join by (row, stretch of ``SCOPE`` code points): a partner ends within ``SCOPE`` before a candidate, or starts
within ``SCOPE`` behind it. Ends and starts of a class within a stretch are first reduced to the least and the greatest. Of the two
stretches that a scope's side meets, the one needs only the greatest and the other only the least, so a candidate meets one row
for each class, side and stretch, whatever the number of parts in a text, and nothing is lost.

Nulls: a null text is an empty one; a null ``doc_id`` is carried. Repeated rows are each returned with equal
results. Positions are code points, ends exclusive. Texts without a match cost one search for each pattern; the
positions of many matches in one long text are summed in blocks. An empty table gives an empty table. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.plan import let
from colloquy.llm.store import written

SCOPE = 200
_BLOCK = 128


class Kind(NamedTuple):
    name: str
    pattern: str
    #: The match group with the value, and the least length it must have.
    group: int
    least: int
    #: Patterns that the value must hold besides.
    also: tuple[str, ...] = ()


# The base patterns, in the order in which equal starts are listed.
BASE = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Weak parts, reported when linked; an endpoint only helps to link.
WEAK = (
    Kind("ident", r"""((?i:user(?:name)?|login|account|client_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 2, 3),
    Kind("secret", r"[A-Za-z0-9/+_-]{32,}", 0, 32, ("[0-9]", "[A-Z]", "[a-z]")),
)
ENDPOINT = Kind("endpoint", r"""(?:https?|jdbc:[a-z]+|s3|ftp)://[A-Za-z0-9.-]+[^\x00-\x20"'<>]*""", 0, 8)
ORDER = {kind.name: number for number, kind in enumerate((*BASE, *WEAK))}

SPANS = "array<struct<start: int, kind: int, end: int>>"


def _running(lengths: Column) -> Column:
    """Sum of the lengths before each element; blocks keep the work near linear."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def of_blocks(own: Column) -> Column:
        count = F.ceil(F.size(own) / F.lit(_BLOCK)).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda b: total(F.slice(own, b * _BLOCK + 1, F.lit(_BLOCK))))

    def prefixes(own: Column) -> Column:
        return let(
            of_blocks(own),
            lambda sums: let(
                F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b))),
                lambda bases: F.transform(
                    own,
                    lambda _, i: F.get(bases, F.floor(i / F.lit(_BLOCK)).cast("int"))
                    + total(F.slice(own, i - i % _BLOCK + 1, i % _BLOCK)),
                ),
            ),
        )

    return let(lengths, prefixes)


def spans(text: Column, kind: Kind, number: int) -> Column:
    """Spans of a kind: what lies between the matches and the matches themselves give the positions."""
    pattern = F.lit(kind.pattern)

    def placed(whole: Column) -> Column:
        gaps = F.split(text, kind.pattern, -1)
        ends = F.zip_with(gaps, whole, lambda gap, match: F.length(gap) + F.coalesce(F.length(match), F.lit(0)))
        value = whole if kind.group == 0 else F.regexp_extract_all(text, pattern, F.lit(kind.group))
        return let(
            _running(ends),
            lambda before: F.transform(
                F.arrays_zip(whole.alias("whole"), value.alias("value"), F.slice(before, F.lit(2), F.size(whole)).alias("end")),
                lambda m: m,
            ),
        )

    def good(m: Column) -> Column:
        size = F.length(m["value"])
        out = size >= kind.least
        for pattern_ in kind.also:
            out = out & m["value"].rlike(pattern_)
        return out

    found = let(F.regexp_extract_all(text, pattern, F.lit(0)), placed)
    kept = F.transform(
        F.filter(found, good),
        lambda m: F.struct(
            (m["end"] - F.length(m["whole"])).cast("int").alias("start"),
            F.lit(number).alias("kind"),
            m["end"].cast("int").alias("end"),
        ),
    )
    return F.when(text.rlike(kind.pattern), kept).otherwise(F.array().cast(SPANS)).cast(SPANS)


def _listed(parts: Column) -> Column:
    """``kind:start:end`` of all spans by start, then kind, joined by commas."""
    names = F.array(*[F.lit(name) for name in ORDER])
    return F.array_join(
        F.transform(F.sort_array(parts), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def parts(docs: DataFrame) -> DataFrame:
    """``doc_id``, a row key, and the spans of each base kind, weak kind and of endpoints."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)).cast("bigint")).alias("_id"),
        F.xxhash64(whole).alias("_hash"),
        whole.alias("_text"),
    )
    text = F.col("_text")
    found = [spans(text, kind, ORDER[kind.name]).alias(kind.name) for kind in (*BASE, *WEAK)]
    return keyed.select("doc_id", "_id", "_hash", *found, spans(text, ENDPOINT, len(ORDER)).alias(ENDPOINT.name))


def linked(found: DataFrame) -> DataFrame:
    """``_id``, ``_hash`` and the weak spans that have a complementary part in scope."""
    # Which classes of parts complete a weak candidate.
    needs = {"secret": ("access", "ident", "endpoint"), "ident": ("secret", "assign")}
    weak = F.concat(*[F.col(name) for name in needs])
    some = found.filter(F.size(weak) > 0)
    start, end = F.col("span.start"), F.col("span.end")

    def probe(side: str, stretch: Column, low: Column, high: Column) -> Column:
        return F.struct(F.lit(side).alias("side"), stretch.cast("bigint").alias("part"), low.alias("low"), high.alias("high"))

    def stretch_of(at: Column) -> Column:
        return F.floor(at / F.lit(SCOPE))

    before, behind = stretch_of(start), stretch_of(end)
    probes = F.array(
        *[probe("end", before - i, start - SCOPE, start) for i in (1, 0)],
        *[probe("start", behind + i, end, end + SCOPE) for i in (0, 1)],
    )
    spans_ = some.select("_id", "_hash", F.explode(F.array_distinct(weak)).alias("span"))
    candidates = spans_.select("_id", "_hash", "span", F.inline(probes))
    classes = sorted({name for names in needs.values() for name in names})

    def named(name: str) -> Column:
        ends = lambda s: F.struct(F.lit(name).alias("of"), s["start"].alias("start"), s["end"].alias("end"))
        return F.transform(F.col(name), ends)

    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"p.{side}").alias("at")) for side in ("start", "end")])
    points = (
        some.select("_id", "_hash", F.explode(F.concat(*map(named, classes))).alias("p"))
        .select("_id", "_hash", "p.of", F.inline(sides))
        .groupBy("_id", "_hash", "side", stretch_of(F.col("at")).alias("part"), "of")
        .agg(F.min("at").alias("first"), F.max("at").alias("last"))
    )
    pairs = F.lit(False)
    for name, partners in needs.items():
        pairs = pairs | ((F.col("span.kind") == ORDER[name]) & F.col("of").isin(*partners))
    # A side of a scope is as long as a stretch, so a stretch reaches beyond it at one end at most.
    inside = F.col("first").between(F.col("low"), F.col("high")) | F.col("last").between(F.col("low"), F.col("high"))
    met = candidates.join(points, ["_id", "_hash", "side", "part"]).filter(pairs & inside)
    return met.groupBy("_id", "_hash").agg(F.collect_set("span").alias("weak"))


def scan(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the base spans and all spans of each whole text.

    Columns: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``n_linked``, ``base`` and ``spans`` as text.
    """
    found = written(parts(docs), "secret-parts")
    out = found.join(linked(found), ["_id", "_hash"], "left")
    base = F.concat(*[F.col(kind.name) for kind in BASE])
    weak = F.coalesce(F.col("weak"), F.array().cast(SPANS))
    counts = [F.size(kind.name).cast("bigint").alias(f"n_{kind.name}") for kind in BASE]
    return out.select(
        "doc_id", *counts, F.size(weak).cast("bigint").alias("n_linked"), _listed(base).alias("base"), _listed(F.concat(base, weak)).alias("spans")
    )
