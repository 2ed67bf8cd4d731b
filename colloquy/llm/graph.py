"""Connected components of links between 64-bit keys, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.store import checkpointed


def _to_least(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return pairs.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    to_least = _to_least(down)
    hooked = to_least.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.union(to_least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least key reachable) for every node with a link; ``links`` has ``u`` and ``v``.

    A round costs four shuffles of the links; their number grows with the logarithm of the longest chain.
    Each round is checkpointed in the shared folder. Only counts and checksums reach the driver.
    """
    links = checkpointed(links.filter("u <> v").distinct())
    seen = None
    while True:
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        links = checkpointed(_small_star(_large_star(links)))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
