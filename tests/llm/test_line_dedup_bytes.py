"""Line dedup: words told apart by bytes, postings without leading zeros, and a second pass that needs no texts."""

import random

import numpy as np
import pyarrow as pa

from colloquy.llm import line_dedup
from colloquy.llm.words import Words, chunk_lanes, mixed, split


def test_words_by_bytes_are_those_of_split():
    rng = random.Random(5)
    words = ["".join(rng.choice("ab\0é\x85") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 255, 256, 257, 600]))) for _ in range(400)]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\n", "\t", "\r\n", "\x0b \x0c", "\n\n"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    for array in (pa.array(["", *texts, " \n"]), pa.array(texts).slice(7, 20), pa.array(["", " ", "\n\n"]), pa.array(["a", "a\0", "a b"])):
        lines = [x for text in array.to_pylist() for x in text.split("\n")]
        offsets, codes, distinct = split(pa.array(lines))
        found = Words(array)
        own, one, two = found.coded()
        assert found.offsets.tolist() == offsets.tolist()
        assert np.diff(found.heads).tolist() == [x.count("\n") + 1 for x in array.to_pylist()]
        assert len(one) == len(set(codes.tolist())) == len(set(zip(own.tolist(), codes.tolist())))
        for mine, other in zip((one, two), chunk_lanes(distinct)):
            assert (mine[own] == other[codes]).all()
        assert (found.hashes() == one[own]).all()


def test_long_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr("colloquy.llm.words.mixed", lambda x: mixed(x) if len(x) == 1 else x * np.uint64(0))
    words = [f"{i % 50:08}same{i % 2}" for i in range(300)] + [f"{i % 7}" for i in range(20)]
    codes = Words(pa.array([" ".join(words)])).coded()[0].tolist()
    assert len(set(zip(codes, words))) == len(set(words)) == len(set(codes))


def _postings(rng: random.Random, n: int) -> np.ndarray:
    lines = []
    for i in range(n):
        own = [f"w{int(rng.paretovariate(0.4)) % 900}" for _ in range(rng.randrange(4, 40))]
        lines += [" ".join(own), " ".join(own[:-1] + [f"x{i}"] if i % 3 else own[: len(own) // 2]), " ".join(own[:-1] + [f"y{i}"])]
    table = np.zeros(line_dedup.BUCKETS, np.int64)
    np.add.at(table, (Words(pa.array(lines)).hashes() % np.uint64(line_dedup.BUCKETS)).astype(np.int64), 1)
    ids = np.arange(len(lines))
    return line_dedup.line_sets(pa.array(lines), table, ids, ids * 0, None, lambda key: (key % 5).astype(np.int64))[4]


def test_blobs_hold_the_postings_without_leading_zeros():
    posting = _postings(random.Random(6), 400)
    blobs = line_dedup._blobs(0, posting, (posting["key"] % 5).astype(np.int64)).column("blob").to_pylist()
    assert sum(map(len, blobs)) < 54 * len(posting)  # 72 bytes each in whole records
    back, names = line_dedup.unpacked(blobs, line_dedup.POSTING), list(line_dedup.POSTING.names)
    assert np.sort(back, order=names).tobytes() == np.sort(posting, order=names).tobytes()


def test_stored_postings_make_all_further_pairs():
    posting = _postings(random.Random(7), 400)
    kept, pairs = line_dedup._candidates(posting)
    stored = line_dedup._met(kept, pairs)
    every = np.full(line_dedup.BITS // 8, 255, np.uint8)
    named = set(zip(kept["set"][pairs[:, 0]].tolist(), kept["key"][pairs[:, 0]].tolist()))
    whole, some = ({(x, y, k) for (x, y), k in zip(p.tolist(), key.tolist()) if (x, k) in named} for p, key in (line_dedup.candidates(q, every) for q in (posting, stored)))
    assert whole == some and len(whole) > len(named) and len(stored) < len(kept)
