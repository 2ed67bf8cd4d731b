"""Scoring with a class-based bigram model whose classes an exchange clustering finds.

The probability of a token is that of its class after the class before it, times that of the word in its class. The end
of a text is a token, and stands before the first word. Every word that makes at least ``FLOOR`` of the training tokens
(so there are at most ``1 / FLOOR``) is exchanged between ``CLASSES`` classes; the others stay in classes by their
shape. All tokens count in all statistics, and each word has its own emission count.

Exchange: a round gathers, over all training texts, how often each clustered word follows and precedes each class. Then
half of the words (by turns) move to the class that raises the likelihood of the class bigrams most, given the classes
of the round before. The best assignment seen is kept.

Counts of all distinct words stay in a Spark table, dealt to parts by a hash of the word. Texts are dealt to blocks of
about ``BLOCK_BYTES``; a block asks each part once, with all its distinct words there, and gets their counts back in the
order of their hashes. So neither a word nor a document is a join key with many rows, words travel as one row for each
block and part, and no vocabulary is broadcast but the clustered words.

Nulls: a null text is an empty one and has the end token only; a null ``doc_id`` counts as empty text in the hold-out
rule, which holds it out. Repeated rows count and are scored each. A text of any length is one row of its block. Without training
texts all probabilities are those of the smoothing. An empty table gives an empty table. Only ``doc_id`` and ``text`` are
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.store import written
from colloquy.llm.words import chunk_lanes, split, text_slices

CLASSES = 48
FLOOR = 2e-5
ROUNDS = 5
ADDED = 0.1
BLOCK_BYTES = 3 << 20
SLICE = 2 << 20
#: Bytes of text whose words one task counts and looks up.
PART_BYTES = 8 << 20
#: Distinct words of which a task holds the counts before it hands them on.
HELD = 1 << 18
#: The end of a text; no word can hold a line feed.
END = "\n"
SHAPES = 8
_CHUNK = 512


class Model(NamedTuple):
    """What scoring needs besides the counts of the words."""

    words: dict[str, int]
    transition: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    distinct: int
    end_count: int

    @property
    def end_class(self) -> int:
        return self.words[END]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 10 == 0


def _lower(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    return split(pc.ascii_lower(texts))


def shapes(words: pa.Array) -> np.ndarray:
    """Class of an unclustered word: its length in four steps, and whether it ends in a letter or digit."""
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    mark = pc.match_substring_regex(words, r"[[:punct:]]$").to_numpy(zero_copy_only=False)
    return CLASSES + 1 + np.searchsorted([5, 9, 13], length, side="right") + 4 * mark.astype(np.int64)


def _classes(words: pa.Array, known: dict[str, int]) -> np.ndarray:
    """The class of each word, clustered or by shape."""
    if not len(words):
        return np.empty(0, np.int64)
    own = np.fromiter((known.get(word, -1) for word in words.to_pylist()), np.int64, len(words))
    return np.where(own >= 0, own, shapes(words))


def by_part(words: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words by their hash: their order, where each part begins in it, and the numbers of the parts."""
    one, _ = chunk_lanes(words)
    order = np.argsort(one, kind="stable")
    if (one[order][1:] == one[order][:-1]).any():
        order = np.lexsort((pc.rank(words).to_numpy(), one))
    part = (((one[order] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    return order, starts, part[starts]


def _joined_words(words: pa.Array, order: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The words of each part in one string; no word can hold a space."""
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), words.take(pa.array(order)))
    return pc.binary_join(lists, " ")


def _real(words: pa.Array) -> pa.Array:
    return words.filter(pc.greater(pc.binary_length(words), 0))


def _summed(tables: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")])
    return pa.table({"word": summed.column("word"), "n": summed.column("n_sum")})


def word_counts(train: DataFrame, parts: int = 1) -> DataFrame:
    """``part``, ``word``, ``n``: how often each word occurs in the training texts, and the end of a text."""

    def packed(counts: pa.Table) -> pa.RecordBatch:
        words, n = counts.column("word").combine_chunks(), counts.column("n").to_numpy()
        order, starts, part = by_part(words, parts)
        blobs = [x.tobytes() for x in np.split(n[order], starts[1:])]
        columns = [pa.array(part), _joined_words(words, order, starts), pa.array(blobs, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "words", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in text_slices(batches, limit=SLICE):
            _, codes, words = _lower(batch.column("text"))
            seen = np.bincount(codes, minlength=len(words))
            own = pa.table({"word": words, "n": pa.array(seen, pa.int64())}).filter(pa.array(seen > 0))
            held += [own, pa.table({"word": pa.array([END], words.type), "n": pa.array([batch.num_rows], pa.int64())})]
            if sum(t.num_rows for t in held) > 2 * HELD:
                held = [_summed(held)]
                if held[0].num_rows > HELD:
                    yield packed(held.pop())
        if held:
            yield packed(_summed(held))

    def add(table: pa.Table) -> pa.Table:
        words = pc.split_pattern(table.column("words").combine_chunks(), " ").flatten()
        n = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int64)
        summed = _summed([pa.table({"word": words, "n": pa.array(n)})])
        part = pa.array(np.full(summed.num_rows, table.column("part")[0].as_py()))
        return pa.table({"part": part, "word": summed.column("word"), "n": summed.column("n")})

    packs = train.select("text").mapInArrow(run, "part bigint, words string, counts binary")
    return packs.groupBy("part").applyInArrow(add, "part bigint, word string, n bigint")


def _kind(clustered: int) -> str:
    """What holds the number of a clustered word or a shape."""
    return "<u2" if clustered + SHAPES <= 1 << 16 else "<i4"


def _units(train: DataFrame, known: dict[str, int]) -> DataFrame:
    """Each text as the numbers of its clustered words, or of shapes after those; the end leads every text."""
    total, kind = len(known), _kind(len(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=SLICE):
            offsets, codes, words = _lower(batch.column("text"))
            own = np.fromiter((known.get(word, -1) for word in words.to_pylist()), np.int64, len(words))
            own = np.where(own >= 0, own, total + shapes(words) - CLASSES - 1) if len(words) else own
            flat = np.insert(own[codes], offsets[:-1], known[END]).astype(kind)
            yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], names=["units"])

    return train.select("text").mapInArrow(run, "units binary")


def _contexts(units: DataFrame, of: np.ndarray, clustered: int, end: int, total: int) -> DataFrame:
    """``chunk``, ``sums``: how often each clustered word follows and precedes each class, by chunks of words.

    The last chunk holds the sums for shapes.
    """
    size, kind = len(of), _kind(clustered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, before = np.zeros(size * total, np.int64), np.zeros(size * total, np.int64)
        for batch in batches:
            for raw in batch.column("units"):
                own = np.append(np.frombuffer(raw.as_buffer(), kind).astype(np.int64), end)
                left, right = own[:-1], own[1:]
                after += np.bincount(right * total + of[left], minlength=size * total)
                before += np.bincount(left * total + of[right], minlength=size * total)
        both = np.concatenate((after.reshape(size, total), before.reshape(size, total)), axis=1)
        starts = [s for s in range(0, size, _CHUNK) if both[s : s + _CHUNK].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(starts, pa.int64()), pa.array([both[s : s + _CHUNK].tobytes() for s in starts], pa.binary())],
            names=["chunk", "sums"],
        )

    def add(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(raw.as_buffer(), np.int64) for raw in table.column("sums"))
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})

    return units.mapInArrow(run, "chunk bigint, sums binary").groupBy("chunk").applyInArrow(add, "chunk bigint, sums binary")


def _bigrams(contexts: DataFrame, of: np.ndarray, total: int) -> np.ndarray:
    """Class bigram counts; each chunk contributes a matrix of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((total, total), np.int64)
        for batch in batches:
            for start, raw in zip(batch.column("chunk").to_pylist(), batch.column("sums")):
                sums = np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, 2 * total)
                np.add.at(counts.T, of[start : start + len(sums)], sums[:, :total])
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], names=["counts"])

    parts = contexts.mapInArrow(run, "counts binary").collect()
    return sum((np.frombuffer(p["counts"], np.int64).reshape(total, total) for p in parts), np.zeros((total, total), np.int64))


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(bigrams: np.ndarray) -> float:
    """Log likelihood of the class bigrams, without what no exchange changes."""
    counts = bigrams.astype(float)
    return float(_f(counts).sum() - _f(counts.sum(0)).sum() - _f(counts.sum(1)).sum())


def best_class(after: np.ndarray, before: np.ndarray, own: int, bigrams: np.ndarray) -> int:
    """The class in which a word, seen ``after`` and ``before`` each class, raises the likelihood most."""
    counts = bigrams.astype(float)
    counts[:, own] -= after
    counts[own, :] -= before
    counts = np.maximum(counts, 0)
    n = after.sum()
    into, out = counts.sum(0)[:CLASSES], counts.sum(1)[:CLASSES]
    gain = (_f(counts[:, :CLASSES] + after[:, None]) - _f(counts[:, :CLASSES])).sum(0)
    gain += (_f(counts[:CLASSES, :] + before[None, :]) - _f(counts[:CLASSES, :])).sum(1)
    gain -= _f(into + n) - _f(into) + _f(out + n) - _f(out)
    best = int(gain.argmax())
    return best if gain[best] > gain[own] + 1e-9 * abs(gain[own]) else own


def _moves(contexts: DataFrame, of: np.ndarray, bigrams: np.ndarray, clustered: int, end: int, turn: int) -> dict[int, int]:
    total = len(bigrams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, raw in zip(batch.column("chunk").to_pylist(), batch.column("sums")):
                sums = np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, 2 * total).astype(float)
                moved = []
                for unit in range(start, min(clustered, start + len(sums))):
                    if unit != end and unit % 2 == turn:
                        row = sums[unit - start]
                        new = best_class(row[:total], row[total:], int(of[unit]), bigrams)
                        if new != of[unit]:
                            moved.append((unit, new))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m[0] for m in moved], pa.int64()), pa.array([m[1] for m in moved], pa.int64())], names=["unit", "own"]
                )

    return {r["unit"]: r["own"] for r in contexts.mapInArrow(run, "unit bigint, own bigint").collect()}


def train(docs: DataFrame, counts: DataFrame, floor: float = FLOOR, rounds: int = ROUNDS) -> Model:
    """Cluster the frequent words of the training texts and count class bigrams. ``counts`` is ``word_counts`` of ``docs``."""
    seen = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = seen["n"] or 0, seen["v"]
    frequent = counts.filter((F.col("n") >= floor * tokens) | (F.col("word") == END)).orderBy(F.desc("n"), "word").collect()
    words = [r["word"] for r in frequent if r["word"] != END] + [END]
    number = {word: i for i, word in enumerate(words)}
    clustered, end, total = len(words), len(words) - 1, CLASSES + 1 + SHAPES
    of = np.concatenate((np.arange(clustered) % CLASSES, CLASSES + 1 + np.arange(SHAPES)))
    of[end] = CLASSES
    units = written(_units(docs, number), "lm-units")
    best, best_of, best_bigrams = -np.inf, of, np.zeros((total, total), np.int64)
    for turn in range(rounds + 1):
        contexts = written(_contexts(units, of, clustered, end, total), "lm-contexts")
        bigrams = _bigrams(contexts, of, total)
        if (value := likelihood(bigrams)) > best:
            best, best_of, best_bigrams = value, of, bigrams
        if turn == rounds:
            break
        of = of.copy()
        for unit, new in _moves(contexts, of, bigrams, clustered, end, turn % 2).items():
            of[unit] = new
    known = {word: int(best_of[i]) for word, i in number.items()}

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _classes(batch.column("word"), known)
            n = np.bincount(own, weights=batch.column("n").to_numpy(), minlength=total).astype(np.int64)
            v = np.bincount(own, minlength=total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total)), pa.array(n), pa.array(v)], names=["c", "n", "v"])

    sums = counts.mapInArrow(totals, "c bigint, n bigint, v bigint").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    class_tokens, class_words = np.zeros(total), np.zeros(total)
    for r in sums.collect():
        class_tokens[r["c"]], class_words[r["c"]] = r["n"], r["v"]
    transition = (best_bigrams + ADDED) / (best_bigrams.sum(1, keepdims=True) + ADDED * total)
    ends = next((r["n"] for r in frequent if r["word"] == END), 0)
    return Model(known, transition, class_tokens, class_words, tokens, distinct, ends)


def asked(texts: pa.Array, parts: int) -> tuple[np.ndarray, pa.Array]:
    """The parts of a block's distinct words, and the words of each."""
    words = _real(_lower(texts)[2])
    order, starts, part = by_part(words, parts)
    return part, _joined_words(words, order, starts)


def looked_up(questions: pa.Array, words: pa.Array, n: np.ndarray) -> list[bytes]:
    """The counts of the words in each question, in as many bytes each as the largest one takes."""
    lists = pc.split_pattern(questions, " ")
    at = pc.index_in(lists.flatten(), words).fill_null(len(words)).to_numpy()
    found, cuts = np.append(n, 0)[at], lists.offsets.to_numpy()
    return [(own := found[a:b]).astype(np.min_scalar_type(own.max())).tobytes() for a, b in zip(cuts[:-1] - cuts[0], cuts[1:] - cuts[0])]


def _block_scores(model: Model, texts: pa.Array, parts: int, answers: dict[int, bytes]) -> tuple[np.ndarray, ...]:
    offsets, codes, words = _lower(texts)
    real = np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False))
    order, starts, part = by_part(words.take(pa.array(real)), parts)
    n = np.zeros(len(words) + 1)
    for which, own in zip(part.tolist(), np.split(real[order], starts[1:])):
        raw = answers[which]
        n[own] = np.frombuffer(raw, f"<u{len(raw) // len(own)}")
    n[-1] = model.end_count
    own = np.append(_classes(words, model.words), model.end_class)
    flat = np.insert(codes.astype(np.int64), offsets[1:], len(words))
    starts = offsets[:-1] + np.arange(len(offsets) - 1)
    base = np.log10((n + ADDED) / (model.tokens + ADDED * (model.distinct + 1)))
    emission = np.log10((n + ADDED) / (model.class_tokens[own] + ADDED * (model.class_words[own] + 1)))
    classes = own[flat]
    before = np.concatenate(([model.end_class], classes[:-1]))
    score = emission[flat] + np.log10(model.transition[before, classes])
    sums = [np.add.reduceat(x, starts) for x in ((n > 0)[flat].astype(np.int64), base[flat], score)]
    return np.diff(offsets) + 1, *sums


def scored(docs: DataFrame, floor: float = FLOOR, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of each whole text,
    and ``perplexity`` of the model."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text.alias("text"))
    learn = rows.filter(~F.col("held_out")).select("text")
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    blocks, parts = max(1, size // BLOCK_BYTES), max(1, size // PART_BYTES)
    counts = written(word_counts(learn, parts), "lm-counts")
    model = spark.sparkContext.broadcast(train(learn, counts, floor, rounds))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition("block")

    def ask(table: pa.Table) -> pa.Table:
        part, words = asked(table.column("text").combine_chunks(), parts)
        return pa.table({"block": pa.array(np.full(len(part), table.column("block")[0].as_py())), "part": pa.array(part), "words": words})

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), "counts": pa.array([], pa.binary())})
        found = looked_up(left.column("words").combine_chunks(), right.column("word").combine_chunks(), right.column("n").to_numpy())
        return pa.table({"block": left.column("block"), "part": left.column("part"), "counts": pa.array(found, pa.binary())})

    # All columns go along, so that both sides read one shuffle of the texts.
    questions = dealt.groupBy("block").applyInArrow(ask, "block bigint, part bigint, words string")
    answers = questions.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(look_up, "block bigint, part bigint, counts binary")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        own = model.value
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, types)})
        texts = left.column("text").combine_chunks()
        given = dict(zip(right.column("part").to_pylist(), right.column("counts").to_pylist()))
        n_tokens, n_known, base, score = _block_scores(own, texts, parts, given)
        ppl = np.power(10.0, -score / n_tokens)
        columns = [left.column("doc_id"), left.column("held_out"), pa.array(n_tokens), pa.array(n_known), pa.array(np.full(len(base), own.tokens)), pa.array(base), pa.array(score), pa.array(ppl)]
        return pa.table(dict(zip(names, columns)))

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answer, schema)
