"""Many patterns at once: patterns are a table of any size, matched through a join of q-grams with texts.

Each pattern is found by one of its q-grams (``GRAM`` characters, or all of a shorter pattern): the rarest among its own, by counts over a
sample of the texts; the sample bears on the time only. Texts are cut into blocks of ``BLOCK`` characters, each with as much behind it
as the longest pattern needs. A block gives each of its q-grams once, as a number below ``BUCKETS``, and only those that are the key of a
pattern; it meets a pattern at most once, however often its q-gram stands there, and is then compared with it as a whole.

Neither side carries a hint: Spark broadcasts the patterns if they are measured to be small, and otherwise shuffles by q-gram, where adaptive
execution splits a frequent one. Null and empty patterns match nothing; repeated patterns count once; null texts have no places.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.plan import exploded, let
from colloquy.functions.text import py_strip, token_count
from colloquy.operators import scans
from colloquy.session import stored

GRAM = 3
BLOCK = 512
#: Numbers that q-grams are hashed to; q-grams that share one only cost a comparison.
BUCKETS = 1 << 20
#: One block in so many has its q-grams counted, to pick the keys of patterns.
SAMPLED = 64
_SLICE = 1000


def gram_buckets(texts: pa.Array, sizes: Sequence[int], wanted: np.ndarray | None = None) -> pa.Array:
    """The numbers of each text's q-grams of some sizes, each once; with ``wanted``, a flag for each number, only those."""
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(t for t in texts.to_pylist() if t).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))
    found = [np.empty(0, np.int64)]
    for size in sizes:
        n = max(len(points) - size + 1, 0)
        code = points[:n].copy()
        for at in range(1, size):
            code |= (points[at : at + n] + np.uint64(1)) << np.uint64(21 * at)
        bucket = ((code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        good = left[:n] >= size
        if wanted is not None:
            good &= wanted[bucket]
        found.append(owner[:n][good] * BUCKETS + bucket[good])
    pairs = np.unique(np.concatenate(found))
    offsets = np.searchsorted(pairs, np.arange(len(texts) + 1) * BUCKETS)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array((pairs % BUCKETS).astype(np.int32)))


def _buckets(text: Column, sizes: Sequence[int], wanted: np.ndarray | None = None) -> Column:
    """``gram_buckets`` as an expression."""

    @F.arrow_udf("array<int>")
    def buckets(texts: pa.Array) -> pa.Array:
        parts = [gram_buckets(texts.slice(at, _SLICE), sizes, wanted) for at in range(0, len(texts), _SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return buckets(text)


def sentences(df: DataFrame, ids: Sequence[str], text: str, end: str) -> DataFrame:
    """``(ids, sentence, said)``: the non-blank sentences of each text, numbered from 0 with the blank ones."""
    # \\Q..\\E: the sentence mark may be a regex character such as "."
    cut = df.select(*ids, F.split(text, rf"\Q{end}\E").alias("_parts"))
    parts = exploded(cut, "_parts", *ids, pos="sentence", item="said")
    return parts.filter(py_strip(F.col("said")) != "")


def _blocks(rows: DataFrame, ids: Sequence[str], text: str, longest: int) -> DataFrame:
    """``(ids, _from, _piece)``: blocks with their place and what of the text stands behind them."""
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / BLOCK).cast("int"))
    cut = rows.filter(F.length(text) > 0).select(*ids, F.col(text).alias("_text"), F.explode(starts).alias("_n"))
    begin = F.col("_n") * BLOCK
    return cut.select(*ids, begin.alias("_from"), F.substr("_text", begin + 1, F.lit(BLOCK + longest - 1)).alias("_piece"))


def _held(
    rows: DataFrame, patterns: DataFrame, ids: Sequence[str], text: str, pattern: str = "pattern", deal: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """``(ids, pattern, _nth, _tokens, _from, _piece)`` for every pattern that stands in a block and what is behind it, once for each block.

    Also the patterns, each with its number ``_nth``.

    With ``deal``, some of ``ids``, blocks are dealt by these before they meet the patterns: what is then counted by them stays where it is.
    """
    known = patterns.filter(F.length(pattern) > 0).select(F.col(pattern).alias("pattern")).distinct()
    sized = known.withColumn("_size", F.least(F.length("pattern"), F.lit(GRAM)))
    # At most GRAM lengths of q-grams, and one number.
    facts = sized.agg(F.collect_set("_size").alias("sizes"), F.max(F.length("pattern")).alias("longest")).first()
    sizes = sorted(facts["sizes"])
    blocks = _blocks(rows, ids, text, facts["longest"] or 1)
    if not sizes:
        none = blocks.limit(0).select(*ids, F.lit("").alias("pattern"), F.lit(0).cast("bigint").alias("_nth"), F.lit(0).alias("_tokens"), "_from", "_piece")
        return none, none.select("pattern", "_nth")
    sampled = blocks.filter(F.pmod(F.xxhash64("_piece"), F.lit(SAMPLED)) == 0)
    seen = sampled.select(F.explode(_buckets(F.col("_piece"), sizes)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("_seen"))
    grams = None
    for size in sizes:
        own = sized.filter(F.col("_size") == size).select("pattern", F.explode(_buckets(F.col("pattern"), [size])).alias("bucket"))
        grams = own if grams is None else grams.unionByName(own)
    rarest = F.struct(F.coalesce("_seen", F.lit(0)), "bucket")
    keys = grams.join(seen, "bucket", "left").groupBy("pattern").agg(F.min_by("bucket", rarest).alias("bucket"))
    # Stored, so that its size is known when the join is planned.
    number = F.monotonically_increasing_id().alias("_nth")
    keys = stored(keys.select("pattern", number, "bucket", token_count(F.col("pattern")).alias("_tokens")), "pattern-keys")
    # At most BUCKETS numbers, whatever the patterns.
    wanted = np.zeros(BUCKETS, bool)
    wanted[keys.select("bucket").distinct().toArrow().column("bucket").to_numpy()] = True
    marked = blocks.withColumn("_buckets", _buckets(F.col("_piece"), sizes, wanted))
    if deal:
        marked = marked.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *deal)
    met = marked.select(*ids, "_from", "_piece", F.explode("_buckets").alias("bucket")).join(keys, "bucket")
    held = met.filter(F.contains("_piece", "pattern")).select(*ids, "pattern", "_nth", "_tokens", "_from", "_piece")
    return held, keys


def pattern_places(rows: DataFrame, patterns: DataFrame, ids: Sequence[str], text: str, pattern: str = "pattern") -> DataFrame:
    """``(ids, pattern, at)`` for every place (from 0) where a pattern stands in a text; ``ids`` tell the rows apart."""
    starts = F.sequence(F.instr("_piece", F.col("pattern")) - 1, F.least(F.lit(BLOCK), F.length("_piece")) - 1)
    # What begins behind the block is a place of the next one.
    held, _ = _held(rows, patterns, ids, text, pattern)
    begun = held.filter(F.instr("_piece", F.col("pattern")) <= BLOCK)
    tried = begun.select("*", F.explode(starts).alias("_at"))
    places = tried.filter(F.substr("_piece", F.col("_at") + 1, F.length("pattern")) == F.col("pattern"))
    return places.select(*ids, "pattern", (F.col("_from") + F.col("_at")).alias("at"))


def table_hits(df: DataFrame, patterns: DataFrame, ids: Sequence[str], text: str = "text", end: str = "。") -> DataFrame:
    """``(pattern, n_sentences, n_rows)`` of all patterns of a table, as ``examples.pattern_hits`` counts them.

    Blocks are dealt by ``ids``, so what a row holds is counted where its blocks are, and a frequent pattern is spread over its
    rows. Only counts are shuffled after that, unless the patterns are too many to be broadcast.
    """
    held, every = _held(sentences(df, ids, text, end), patterns, [*ids, "sentence"], "said", deal=ids)
    of_row = held.select("_nth", *ids, "sentence").distinct().groupBy("_nth", *ids).agg(F.count("*").alias("_n"))
    counts = of_row.groupBy("_nth").agg(F.sum("_n").alias("n_sentences"), F.count("*").alias("n_rows"))
    zero = F.lit(0).cast("bigint")
    return every.join(counts, "_nth", "left").select(
        "pattern", F.coalesce("n_sentences", zero).alias("n_sentences"), F.coalesce("n_rows", zero).alias("n_rows")
    )


def table_span_mask(
    df: DataFrame,
    patterns: DataFrame,
    ids: Sequence[str],
    text: str = "text",
    mask: str = "attention_mask",
    *,
    end: str = "。",
    pad: int = 2,
    anchor: str = "tail",
) -> DataFrame:
    """``examples.pattern_span_mask`` for a table of patterns; ``ids`` tell the rows apart.

    Marks are grouped by row as ranges of its mask, one for each end, so a group holds no more than the mask has positions.
    """
    if anchor not in ("tail", "actual"):
        raise ValueError(f"unknown anchor {anchor!r}")
    said = sentences(df.select(*ids, text), ids, text, end)
    sized = said.withColumn("_whole", token_count(F.concat("said", F.lit(end)))).withColumn("_own", token_count(F.col("said")))
    placed = scans.running_sums(stored(sized, "sentences"), list(ids), "sentence", _through=F.col("_whole").cast("bigint"))
    placed = stored(placed.withColumn("_start", F.col("_through") - F.col("_whole")), "placed-sentences")
    # Sentences that start beyond the mask cannot reach it.
    width = df.select(*ids, F.size(mask).alias("_width"))
    near = placed.join(width, list(ids)).filter(F.col("_start") <= F.col("_width") + pad + 1)
    of_sentence = [*ids, "sentence", "_start", "_own", "_width"]
    hits, _ = _held(near, patterns, of_sentence, "said", deal=ids)
    size = F.col("_tokens")
    if anchor == "tail":
        begin = F.col("_start") + F.col("_own") - size
    else:
        at = F.col("_from") + F.instr("_piece", F.col("pattern")) - 1
        hits = hits.groupBy(*of_sentence, "_nth", "_tokens").agg(F.min(at).alias("at"))
        said_of = near.select(*ids, "sentence", "said")
        hits = hits.join(said_of, [*ids, "sentence"])
        begin = F.col("_start") + token_count(F.substr("said", F.lit(1), F.col("at")))
    spans = hits.select(
        *ids,
        F.greatest(begin - pad, F.lit(0)).cast("int").alias("low"),
        (F.least(begin + size + pad, F.col("_width")) - 1).cast("int").alias("high"),
    ).filter("low <= high")
    # Of the spans that end at one place, the longest covers the others.
    longest = spans.groupBy(*ids, "high").agg(F.min("low").alias("low"))
    marks = longest.groupBy(*ids).agg(F.collect_list(F.struct("low", "high")).alias("_spans"))
    joined = df.join(marks, list(ids), "left")
    last = F.size(mask) - 1
    covered = let(
        F.array_distinct(
            F.flatten(F.transform(F.coalesce("_spans", F.array().cast("array<struct<low:int,high:int>>")), lambda s: F.sequence(s["low"], s["high"])))
        ),
        lambda held: F.transform(
            mask, lambda old, i: F.when((i == 0) | (i == last) | F.array_contains(held, i), 1).otherwise(old)
        ),
    )
    return joined.withColumn(mask, F.when(F.size(mask) > 0, covered).otherwise(F.col(mask))).drop("_spans")
