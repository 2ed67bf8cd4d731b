"""Mixing sources to target weights by temperature. DataFrame functions only.

A source's weight is its token share to the power of an exponent, normalised. The exponent is bisected
between 0 (all sources alike) and 1 (shares as they are): it is the smallest one at which the entropy of the
weights is at most its target and no source is repeated beyond the limit; 1 if there is none. Weights times the
budget give each source's tokens. They are realised as permutations of its blocks: a block is a group of
documents by hash, about ``BLOCK_TOKENS`` words; each epoch takes all blocks in an order of its own, and the last,
partial one takes blocks as long as the budget holds.

Sums over sources, blocks and positions are Spark aggregations; nothing is sized by the number of sources, and a
large source's blocks are ordered within cells of the hash, so no task orders a whole source.

Nulls: null sources form a source of their own; a null text has no tokens; null ``doc_id`` values share a block.
Repeated rows count as often as they occur and stay together. A source without tokens is taken once.
An empty table gives an empty table. Documents carry all their columns in a struct, so no name clashes.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.store import written
from colloquy.llm.words import WORD

BLOCK_TOKENS = 10_000
#: Blocks that a small source is cut into, so that its budget is met closely.
LEAST_BLOCKS = 64
#: Share of the largest possible entropy that the weights aim at, and the most epochs of a source.
TARGET_ENTROPY = 0.98
MOST_REPEATS = 4.0
SEED = "mix"
_CELLS = 256
_SECTION_BITS, _ROUNDS = 5, 6


class Mix(NamedTuple):
    """``exponent``; ``sources`` with budgets; ``schedule`` with a row for each block and epoch taken."""

    exponent: float
    sources: DataFrame
    schedule: DataFrame


def _hash60(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("bigint")


def counted(docs: DataFrame) -> DataFrame:
    """Documents in the struct ``row`` with their source's key and number of tokens."""
    return docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("_source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_tokens"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_doc"),
    )


def bisect(sources: DataFrame, target: float, most_repeats: float, budget_share: float) -> float:
    """The smallest exponent k / 2^30 with entropy at most ``target`` and repeats within the limit.

    Each round asks one aggregation over all sources for the exponents that cut the interval into 2^5 parts.
    """
    low, high = 0, 1 << (_SECTION_BITS * _ROUNDS)  # the answer lies in [low, high]
    scale = float(high)
    while low < high:
        step = max(1, (high - low) >> _SECTION_BITS)
        asked = list(range(low, high, step))
        grid = F.explode(F.array(*[F.lit(k) for k in asked])).alias("k")
        power = F.pow("share", F.col("k") / F.lit(scale))
        sums = (
            sources.filter("share > 0").select("share", grid).groupBy("k")
            .agg(F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("l"), F.max(power / F.col("share")).alias("r"))
            .collect()
        )
        good = {
            s["k"]
            for s in sums
            if math.log(s["z"]) - s["k"] / scale * s["l"] / s["z"] <= target and s["r"] / s["z"] * budget_share <= most_repeats
        }
        first = next((k for k in asked if k in good), None)
        if first is None:
            low = asked[-1] + 1
        else:
            high = first
            low = max(low, first - step + 1)
    return low / scale


def plan(
    rows: DataFrame,
    budget_tokens: int | None = None,
    target_entropy: float = TARGET_ENTROPY,
    most_repeats: float = MOST_REPEATS,
    block_tokens: int = BLOCK_TOKENS,
    seed: str = SEED,
) -> Mix:
    """Budgets and block schedule for ``rows`` (``_source``, ``_doc``, ``n_tokens``); no texts are needed.

    ``budget_tokens`` is the size of the mix, by default the tokens there are. ``target_entropy`` is a share of
    the logarithm of the number of sources.
    """
    rows = rows.select("_source", "_doc", "n_tokens")
    totals = written(rows.groupBy("_source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")), "mix-sources")
    all_ = totals.agg(F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("tokens") > 0, 1)).alias("sources")).first()
    tokens, n_sources = all_["tokens"] or 0, all_["sources"] or 0
    budget = tokens if budget_tokens is None else budget_tokens
    shares = totals.withColumn("share", F.col("tokens") / F.lit(float(max(tokens, 1))))
    exponent = bisect(shares, target_entropy * math.log(max(n_sources, 1)), most_repeats, budget / max(tokens, 1)) if tokens else 1.0
    power = F.when(F.col("share") > 0, F.pow("share", F.lit(exponent))).otherwise(0.0)
    norm = shares.agg(F.sum(power)).first()[0] or 1.0
    sources = (
        shares.withColumn("weight", power / F.lit(norm))
        .withColumn("budget", F.floor(F.col("weight") * F.lit(budget) + F.lit(0.5)))
        .withColumn("n_blocks", F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("tokens") / F.lit(block_tokens))))
        .withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(1)))
        .withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("full") * F.col("tokens")).otherwise(F.lit(-1)))
    )
    blocks = with_blocks(rows, sources, seed).groupBy("_source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    epochs = (
        blocks.join(sources.select("_source", "tokens", "budget", "full", "rest"), "_source")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full"))))
        .filter((F.col("epoch") < F.col("full")) | (F.col("rest") > 0))
        .withColumn("_key", _hash60(F.lit(seed), F.col("epoch"), F.col("_source"), F.col("block")))
        .withColumn("_cell", F.shiftright("_key", 52))
    )
    epochs = written(epochs, "mix-epochs")
    before = Window.partitionBy("_source", "epoch").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        epochs.groupBy("_source", "epoch", "_cell").agg(F.sum("block_tokens").alias("_tokens"))
        .withColumn("_base", F.coalesce(F.sum("_tokens").over(before), F.lit(0))).drop("_tokens")
    )
    inside = (
        Window.partitionBy("_source", "epoch", "_cell").orderBy("_key", "block").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        epochs.withColumn("_in", F.coalesce(F.sum("block_tokens").over(inside), F.lit(0)))
        .join(cells, ["_source", "epoch", "_cell"])
        .withColumn("_at", F.col("_base") + F.col("_in"))
        .filter((F.col("epoch") < F.col("full")) | (F.col("_at") + F.col("block_tokens") <= F.col("rest")))
        .select("_source", "block", "epoch", (F.col("epoch") * F.col("tokens") + F.col("_at")).alias("before_tokens"), "budget")
    )
    return Mix(exponent, sources, placed)


def with_blocks(rows: DataFrame, sources: DataFrame, seed: str = SEED) -> DataFrame:
    """Add ``block``, a document's block within its source."""
    return (
        rows.join(sources.select("_source", "n_blocks"), "_source")
        .withColumn("block", F.pmod(_hash60(F.lit(seed), F.col("_source"), F.col("_doc")), F.col("n_blocks")))
        .drop("n_blocks")
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """A row for each document and epoch taken: ``row``, ``n_tokens``, ``epoch``, ``block``, ``before_tokens`` (the
    source's tokens ahead of the block) and ``budget_tokens``. Ordered by ``before_tokens / budget_tokens``, the
    sources interleave evenly.
    """
    rows = counted(docs)
    mix = plan(rows, **settings)
    return (
        with_blocks(rows, mix.sources, settings.get("seed", SEED))
        .join(mix.schedule, ["_source", "block"])
        .select("row", "n_tokens", "epoch", "block", "before_tokens", F.col("budget").alias("budget_tokens"))
    )
