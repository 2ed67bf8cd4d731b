"""Links inside a shard against all pairs, where the tree has more than one leaf."""

import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import simhash as S


def near_pairs(seed, n, near):
    """Random fingerprints, and for some of them another that is two bits away at most; ascending."""
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
    flips = np.uint64(1) << rng.integers(0, 64, (2, near)).astype(np.uint64)
    return np.unique(np.concatenate((base, base[:near] ^ (flips[0] | flips[1]))))


def all_pairs(prints):
    return set(zip(*(side.tolist() for side in np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= S.MOST_BITS, 1)))))


def test_links_of_a_tree_with_leaves():
    for seed in range(3):
        prints = near_pairs(seed, 2000, 600)
        a, b = S.links(prints, prints[:0])
        got = [(min(pair), max(pair)) for pair in zip(a.tolist(), b.tolist())]
        assert len(got) == len(set(got)) and set(got) == all_pairs(prints)
        # The same with part of them as probes, which are not linked with each other.
        home, probes = prints[::2], prints[1::2]
        both = np.concatenate((home, probes))
        a, b = S.links(home, probes)
        got = {(min(pair), max(pair)) for pair in zip(a.tolist(), b.tolist())}
        assert got == {(i, j) for i, j in all_pairs(both) if i < len(home)}


def test_components_of_pairs(spark):
    prints = near_pairs(9, 1500, 500)
    pairs = all_pairs(prints)
    frame = spark.createDataFrame([(v,) for v in prints.view(np.int64).tolist()], "fp bigint")
    for shard in (20_000, 400):
        found = S.components(S.linked(frame, shard=shard)).groupBy("root").agg(F.collect_set("node").alias("nodes")).collect()
        root = {node: row["root"] for row in found for node in row["nodes"]}
        signed = prints.view(np.int64).tolist()
        assert all(root[signed[i]] == root[signed[j]] for i, j in pairs)
