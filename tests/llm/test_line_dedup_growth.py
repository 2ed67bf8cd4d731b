"""Line dedup: what its filters let through, and passes that look at fewer lines lose none."""

import random

import numpy as np
import pyarrow as pa

from colloquy.llm import line_dedup


def test_unlike_lines_of_a_hundred_words_make_few_candidates():
    """Sets that share one rare word and nothing else; 64 parities took some hundred pairs of them for similar."""
    rng = random.Random(3)
    lines = ["rare " + " ".join(f"w{x}" for x in rng.sample(range(100_000), 118)) for _ in range(300)]
    table = np.full(line_dedup.BUCKETS, 900)
    table[int(line_dedup.chunk_lanes(pa.array(["rare"]))[0][0] % np.uint64(line_dedup.BUCKETS))] = 300
    ids = np.arange(300)
    posting = line_dedup.line_sets(pa.array(lines), table, ids, ids * 0)[4]
    pairs, _ = line_dedup.candidates(posting, np.full(line_dedup.BITS // 8, 255, np.uint8))
    assert len(pairs) < 45


def test_parities_never_hide_a_similar_pair(spark):
    rng = random.Random(4)
    rows = []
    for size in (5, 9, 30, 60, 64, 65, 70, 79, 100, 150, 185, 192, 193, 200, 230, 300):
        words = [f"s{size}w{i}" for i in range(size)]
        for change in (0.0, 0.1, 0.11, 0.12, 0.2):
            kept = words[: round(size * (1 - change))] + [f"s{size}c{change}x{i}" for i in range(rng.randrange(int(size * 0.1) + 1))]
            rng.shuffle(kept)
            rows.append(kept)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id bigint, text string")
    gone = {r["doc_id"] for r in line_dedup.deduped(docs).filter("n_removed > 0").select("row.doc_id").collect()}
    sets = [set(w) for w in rows]
    expected = {i for i, a in enumerate(sets) if any(10 * len(a & b) >= 8 * len(a | b) for b in sets[:i])}
    assert gone == expected and 0 < len(gone) < len(rows)


def test_lines_left_out_post_no_wanted_word(monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 50)
    rng = np.random.default_rng(6)
    texts = pa.array(["\n".join(" ".join(f"w{int(x) % 700}" for x in rng.pareto(0.5, rng.integers(0, 30)) * 3) for _ in range(12)) for _ in range(40)])
    table = np.zeros(line_dedup.BUCKETS, np.int64)
    _, codes, words = line_dedup.split(texts)
    np.add.at(table, (line_dedup.chunk_lanes(words)[0] % np.uint64(line_dedup.BUCKETS)).astype(np.int64), np.bincount(codes, minlength=len(words)))
    assert (table > 50).any()
    ids = np.arange(len(texts))
    whole = line_dedup.line_sets(texts, table, ids, ids * 0)[4]
    for share in (3, 40):
        bits = np.zeros(line_dedup.BITS, np.uint8)
        bits[whole["key"][::share] % line_dedup.BITS] = 1
        wanted = np.packbits(bits, bitorder="little")
        some = line_dedup.line_sets(texts, table, ids, ids * 0, wanted)[4]
        kept = [np.sort(p[line_dedup._in(wanted, p["key"])], order=["key", "set"]) for p in (whole, some)]
        assert len(kept[0]) and kept[0].tobytes() == kept[1].tobytes()
        assert len(some) < len(whole) or share == 3


def test_words_are_ordered_by_count_then_hash():
    rng = np.random.default_rng(2)
    counts, one, two = rng.integers(1, 4, 400), rng.integers(0, 3, 400).astype(np.uint64) << np.uint64(50), rng.integers(0, 1 << 60, 400).astype(np.uint64)
    assert line_dedup.by_rarity(counts, one, two).tolist() == np.lexsort((two, one, counts)).tolist()
