"""The words of the class model travel packed by block and part, and the numbers of both change no result."""

import random

import numpy as np
import pyarrow as pa

from colloquy.llm import class_lm

NAMES = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def rows_of(frame):
    return sorted((tuple(r[n] for n in NAMES) for r in frame.collect()), key=repr)


def test_blocks_and_parts_change_no_score(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(f"w{int(rng.paretovariate(0.4)) % 900}" for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = [(i % 140, t) for i, t in enumerate(texts)] + [(None, "Tür w1"), (5, None), (6, " \n "), (7, texts[7]), (7, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    one = rows_of(class_lm.scored(docs, rounds=1))
    monkeypatch.setattr(class_lm, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(class_lm, "PART_BYTES", 1000)
    frame = class_lm.scored(docs, rounds=1)
    assert rows_of(frame) == one and len(one) == len(rows)
    # No row for each word and block is sorted and joined.
    assert "Join" not in frame._jdf.queryExecution().executedPlan().toString()


def test_counts_come_back_in_the_order_of_the_question():
    words = pa.array([f"w{i}" for i in range(500)] + ["Tür", "x" * 400])
    n = np.arange(len(words)) * 700
    order, starts, part = class_lm.by_part(words, 7)
    assert sorted(order.tolist()) == list(range(len(words))) and part.tolist() == list(range(7))
    again = words.take(pa.array(np.random.default_rng(1).permutation(len(words))))
    which, questions = class_lm.asked(pa.array([" ".join(again.to_pylist()) + " unseen0 unseen1", " "]), 7)
    assert which.tolist() == part.tolist()
    for question, raw in zip(questions.to_pylist(), class_lm.looked_up(questions, pa.array([w.lower() for w in words.to_pylist()]), n)):
        own = question.split(" ")
        known = dict(zip([w.lower() for w in words.to_pylist()], n.tolist()))
        assert np.frombuffer(raw, f"<u{len(raw) // len(own)}").tolist() == [known.get(w, 0) for w in own]
