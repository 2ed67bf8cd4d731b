"""Chat training examples: cut, validate, render, length-filter, tokenise, mask, split."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.plan import let, with_computed
from colloquy.functions.text import first_tokens, py_strip, token_count, token_id, tokens
from colloquy.operators import selection
from colloquy.session import stored

# Two utterances per window, the 3rd to the 26th utterance of a dialogue.
WINDOWS = tuple((start, start + 1) for start in range(3, 27, 2))
MAX_TOKENS = 256
# Sentence mark and tone patterns.
SENTENCE_END = "。"
PATTERNS = ("かね", "だろうか", "のかね", "ではないかね", "では", "について", "君は", "君が", "君の")
TURN_OPEN = "<start_of_turn>"
TURN_CLOSE = "<end_of_turn>"
BOS = "<bos>"

PAD_ID, BOS_ID, EOS_ID, RESERVED_IDS = 0, 2, 1, 4
VOCAB = 256_000
#: Stand for the leading id and the padding in a text; one token each under the built-in rule.
BOS_MARK, PAD_MARK = "\ue000", "\ue001"

TokenizerFactory = Callable[[], Callable[[str], Sequence[int]]]


def _usable(windows: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(start, end) for start, end in windows if start and end]


def extract_windows(parsed: DataFrame, *keys: str, windows=WINDOWS) -> DataFrame:
    """One row per complete window of each transcript row: ``(keys, start, end, messages)``. No shuffle."""
    spans = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end")) for s, e in _usable(windows)])
    fitting = F.filter(
        spans, lambda w: (w["start"] <= F.size("turns")) & (w["end"] <= F.size("turns"))
    )
    return parsed.select(*keys, "turns", F.explode(fitting).alias("w")).select(
        *keys,
        F.col("w.start").alias("start"),
        F.col("w.end").alias("end"),
        F.slice("turns", F.col("w.start"), F.col("w.end") - F.col("w.start") + 1).alias("messages"),
    )


def windows_from_turns(turns: DataFrame, *keys: str, windows=WINDOWS) -> DataFrame:
    """The same windows from long turns ``(keys, turn, speaker, text)`` with ``turn`` dense from 0.

    Turns outside every window are dropped before the shuffle and a group holds one window, so a
    very long dialogue costs no more than a short one.
    """
    spans = _usable(windows)
    if not spans:
        return turns.limit(0).select(
            *keys, F.lit(0).alias("start"), F.lit(0).alias("end"), F.array(F.struct("speaker", "text")).alias("messages")
        )
    utterance = F.col("turn") + 1
    literal = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end")) for s, e in spans])
    inside = F.filter(literal, lambda w: (w["start"] <= utterance) & (utterance <= w["end"]))
    return (
        turns.filter((utterance >= min(s for s, _ in spans)) & (utterance <= max(e for _, e in spans)))
        .withColumn("w", F.explode(inside))
        .groupBy(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"))
        .agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "text"))).alias("found"))
        .filter(F.size("found") == F.col("end") - F.col("start") + 1)
        .select(
            *keys,
            "start",
            "end",
            F.transform("found", lambda m: F.struct(m["speaker"].alias("speaker"), m["text"].alias("text"))).alias(
                "messages"
            ),
        )
    )


def to_chat(windows: DataFrame, source: str, prefix: str = "") -> DataFrame:
    """Chat examples ``(source_file, extract_range, messages)``; newlines become a literal ``\\n``."""
    return windows.select(
        F.col(source).cast("string").alias("source_file"),
        F.concat_ws("-", "start", "end").alias("extract_range"),
        F.transform(
            "messages",
            lambda m, i: F.struct(
                F.when(m["speaker"] == "User", "user").otherwise("model").alias("role"),
                F.concat(F.when(i == 0, prefix).otherwise(""), F.replace(m["text"], F.lit("\n"), F.lit("\\n"))).alias(
                    "content"
                ),
            ),
        ).alias("messages"),
    )


def valid_messages(messages: Column) -> Column:
    """Every message has a known role and a content."""
    return F.forall(
        messages, lambda m: F.coalesce(m["role"].isin("user", "model"), F.lit(False)) & m["content"].isNotNull()
    )


def paired_messages(messages: Column) -> Column:
    """Messages without an odd tail."""
    return F.slice(messages, 1, F.size(messages) - F.size(messages) % 2)


def alternating(messages: Column) -> Column:
    """Every (even, odd) pair is user then model, and there is at least one pair."""
    kept = paired_messages(messages)
    in_order = F.forall(
        F.transform(kept, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("model")),
        lambda ok: F.coalesce(ok, F.lit(False)),
    )
    return (F.size(kept) > 0) & in_order


def render_chat(
    messages: Column,
    *,
    open_mark: str = TURN_OPEN,
    close_mark: str = TURN_CLOSE,
    bos: str = BOS,
    add_generation_prompt: bool = True,
) -> Column:
    """Chat-template text of a message array."""
    body = F.array_join(
        F.transform(
            messages,
            lambda m: F.concat(F.lit(open_mark), m["role"], F.lit("\n"), py_strip(m["content"]), F.lit(close_mark + "\n")),
        ),
        "",
    )
    return F.concat(F.lit(bos), body, F.lit(f"{open_mark}model\n" if add_generation_prompt else ""))


def length_udf(factory: TokenizerFactory):
    """Token count by a real tokenizer, loaded once per task and fed Arrow batches."""

    @F.pandas_udf(T.IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for texts in batches:
            yield texts.map(lambda text: len(encode(text)))

    return count


def classify_examples(
    examples: DataFrame, max_tokens: int = MAX_TOKENS, tokenizer: TokenizerFactory | None = None
) -> DataFrame:
    """Add ``text``, ``n_tokens`` and ``reject_reason`` (null for usable examples).

    Checks run from cheap to costly: format, alternation, then length. Only rows that pass the
    first two are rendered and counted.
    """
    format_ok = F.coalesce(valid_messages(F.col("messages")), F.lit(False))
    order_ok = alternating(F.col("messages"))
    reason = F.when(~format_ok, "format").when(F.size("messages") < 2, "empty").when(~order_ok, "order")
    early = with_computed(examples, _early=reason)
    passed = F.col("_early").isNull()
    rendered = with_computed(early, text=F.when(passed, render_chat(paired_messages(F.col("messages")))))
    if tokenizer is None:
        counted = with_computed(rendered, n_tokens=F.when(passed, token_count(F.col("text"))))
    else:
        lengths = length_udf(tokenizer)(F.coalesce("text", F.lit("")))
        counted = rendered.withColumn("_n", lengths).withColumn("n_tokens", F.when(passed, F.col("_n"))).drop("_n")
    too_long = F.when(F.col("n_tokens") > max_tokens, "length")
    return counted.withColumn("reject_reason", F.coalesce("_early", too_long)).drop("_early")


def within_token_budget(
    df: DataFrame, text: str = "text", max_tokens: int = MAX_TOKENS, tokenizer: TokenizerFactory | None = None
) -> DataFrame:
    if tokenizer is None:
        sized = with_computed(df, n_tokens=token_count(F.col(text)))
    else:
        sized = df.withColumn("n_tokens", length_udf(tokenizer)(F.col(text)))
    return sized.filter(F.col("n_tokens") <= max_tokens)


def reject_report(classified: DataFrame) -> DataFrame:
    return classified.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reject_reason")).agg(
        F.count("*").alias("n")
    )


def profile_examples(df: DataFrame, size: Column) -> DataFrame:
    """Counts and size range over all rows."""
    return df.select(size.alias("_size")).agg(
        F.count("*").alias("n_rows"),
        F.count("_size").alias("n_sized"),
        F.min("_size").alias("min_size"),
        F.max("_size").alias("max_size"),
        F.sum("_size").alias("total_size"),
    )


def tokenize_pad(df: DataFrame, text: str = "text", max_len: int = MAX_TOKENS) -> DataFrame:
    """``input_ids`` and ``attention_mask`` of exactly ``max_len`` under the built-in token rule."""
    first = tokens(first_tokens(F.col(text), max_len - 1))
    kept = F.concat(F.array(F.lit(BOS_ID)), F.transform(first, lambda t: token_id(t, VOCAB, RESERVED_IDS)))
    missing = F.lit(max_len) - F.size("_kept")
    return (
        with_computed(df, _kept=kept)
        .withColumn("input_ids", F.concat("_kept", F.array_repeat(F.lit(PAD_ID), missing)))
        .withColumn(
            "attention_mask",
            F.concat(F.array_repeat(F.lit(1), F.size("_kept")), F.array_repeat(F.lit(0), missing)),
        )
        .drop("_kept")
    )


def tokenize_pad_with(
    df: DataFrame, factory: TokenizerFactory, text: str = "text", max_len: int = MAX_TOKENS, pad_id: int = PAD_ID
) -> DataFrame:
    """The same through a real tokenizer, one load per task."""
    schema = T.StructType(
        df.schema.fields
        + [
            T.StructField("input_ids", T.ArrayType(T.IntegerType())),
            T.StructField("attention_mask", T.ArrayType(T.IntegerType())),
        ]
    )

    def encode_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = factory()
        for batch in batches:
            ids = [list(encode(value))[:max_len] for value in batch[text]]
            yield batch.assign(
                input_ids=[row + [pad_id] * (max_len - len(row)) for row in ids],
                attention_mask=[[1] * len(row) + [0] * (max_len - len(row)) for row in ids],
            )

    return df.mapInPandas(encode_batches, schema)


def _sentences(text: Column, end: str) -> Column:
    # \Q..\E: the sentence mark may be a regex character such as "."
    return F.filter(F.split(text, rf"\Q{end}\E"), lambda s: py_strip(s) != "")


def pattern_hits(
    df: DataFrame, text: str = "text", patterns: Sequence[str] = PATTERNS, end: str = SENTENCE_END
) -> DataFrame:
    """Per pattern, the number of non-blank sentences that contain it: ``(pattern, n_sentences, n_rows)``.

    Every row is reduced to one number per pattern before the aggregation, so the shuffle carries
    one row per task.
    """

    def sentences_with(pattern: str) -> Column:
        return F.coalesce(F.size(F.filter("_s", lambda s: s.contains(pattern))), F.lit(0))

    hits = df.select(_sentences(F.col(text), end).alias("_s"))
    hits = hits.select(*[sentences_with(p).alias(f"_p{i}") for i, p in enumerate(patterns)])
    totals = hits.agg(
        *[
            F.struct(
                F.lit(p).alias("pattern"),
                F.coalesce(F.sum(f"_p{i}"), F.lit(0)).alias("n_sentences"),
                F.count(F.when(F.col(f"_p{i}") > 0, 1)).alias("n_rows"),
            ).alias(f"_t{i}")
            for i, p in enumerate(patterns)
        ]
    )
    return totals.select(F.inline(F.array(*[f"_t{i}" for i in range(len(patterns))])))


def pattern_span_mask(
    df: DataFrame,
    text: str = "text",
    mask: str = "attention_mask",
    *,
    patterns: Sequence[str] = PATTERNS,
    end: str = SENTENCE_END,
    pad: int = 2,
    anchor: str = "tail",
    count: Callable[[Column], Column] = token_count,
) -> DataFrame:
    """Set the mask to 1 around every pattern hit, and at both ends.

    ``anchor="tail"`` places a hit at the end of its sentence wherever it stands in it;
    ``anchor="actual"`` places it where the pattern first occurs. Positions count tokens of the
    sentences before, blank sentences left out. Sentences that start past the mask length and the
    widest pattern cannot reach into the mask and are not counted.
    """
    if anchor not in ("tail", "actual"):
        raise ValueError(f"unknown anchor {anchor!r}")
    token_width = {p: count(F.lit(p)) for p in patterns}
    reach = F.size(mask) + max(len(p) for p in patterns) + pad
    def size_of(sentence: Column) -> Column:
        return count(sentence) if anchor == "tail" else F.lit(0)

    # sentences that can reach the mask, with the number of tokens in front of them
    placed = F.aggregate(
        _sentences(F.col(text), end),
        F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<s:string,start:int,size:int>>").alias("out")),
        lambda acc, s: F.when(
            acc["pos"] < reach,
            F.struct(
                (acc["pos"] + count(F.concat(s, F.lit(end)))).alias("pos"),
                F.concat(
                    acc["out"], F.array(F.struct(s.alias("s"), acc["pos"].alias("start"), size_of(s).alias("size")))
                ).alias("out"),
            ),
        ).otherwise(acc),
        lambda acc: acc["out"],
    )

    def positions_for(found: Column, pattern: str) -> Column:
        width = token_width[pattern]

        def span(z: Column) -> Column:
            inside = z["size"] - width if anchor == "tail" else count(F.substring_index(z["s"], pattern, 1))
            return let(z["start"] + inside, around)

        def around(hit: Column) -> Column:
            first = F.greatest(hit - pad, F.lit(0))
            last = F.least(hit + width + pad, F.size(mask)) - 1
            return F.when(first <= last, F.sequence(first, last))

        hits = F.transform(F.filter(found, lambda z: z["s"].contains(pattern)), span)
        return F.flatten(F.filter(hits, lambda p: p.isNotNull()))

    last = F.size(mask) - 1
    covered = let(
        placed,
        lambda found: F.array_distinct(
            F.concat(F.array(F.lit(0), last), *[positions_for(found, p) for p in patterns])
        ),
    )

    def flags(held: Column) -> Column:
        def flagged(positions: Column, flag: int) -> Column:
            return F.transform(positions, lambda i: F.struct(i.alias("i"), F.lit(flag).alias("flag")))

        # one entry per position, brought into order by a sort instead of a search per position
        open_positions = F.array_except(F.sequence(F.lit(0), last), held)
        return F.sort_array(F.concat(flagged(held, 1), flagged(open_positions, 0)))

    merged = F.zip_with(mask, let(covered, flags), lambda old, f: F.when(f["flag"] == 1, 1).otherwise(old))
    return df.withColumn(mask, F.when(F.size(mask) > 0, merged).otherwise(F.col(mask)))


def tokenize_mask(df: DataFrame, text: str = "text", max_len: int = MAX_TOKENS, **spans) -> DataFrame:
    """``tokenize_pad`` with the mask of ``pattern_span_mask``, both on one tokenisation.

    The mask looks at the text the ids stand for: cut at ``max_len``, with the leading id in the first sentence and the
    padding in the last, so its positions are those of ``input_ids``. ``spans`` go to ``pattern_span_mask``.
    """
    cut = with_computed(df, _cut=first_tokens(F.col(text), max_len - 1))
    padded = tokenize_pad(cut, "_cut", max_len)
    padding = F.repeat(F.lit(PAD_MARK), F.size(F.array_remove("attention_mask", 1)))
    whole = with_computed(padded, _whole=F.concat(F.lit(BOS_MARK), "_cut", padding))
    return pattern_span_mask(whole, "_whole", **spans).drop("_cut", "_whole")


def shuffle_key(seed: int, *keys: str) -> Column:
    """Pseudo-random order of rows that depends on their keys only, not on partitioning."""
    return F.xxhash64(F.lit(seed), *keys)


def seeded_shuffle(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Rows in a reproducible random order; a range-partitioned sort, so no single task sees all rows."""
    return df.orderBy(shuffle_key(seed, *keys), *keys)


def _sides(df: DataFrame, groups: DataFrame, keys: Sequence[str], train_fraction: float, eval_cap: int | None) -> DataFrame:
    """Add ``split`` to rows with a ``_rank``, from ``groups`` ``(_rank, keys, _weight)``."""
    def train(total: int) -> int:
        return int(total * train_fraction)

    def evaluate(total: int) -> int:
        return total if eval_cap is None else train(total) + eval_cap

    last_train, last_eval = selection.cuts(groups, "_rank", keys, "_weight", [train, evaluate])
    side = F.when(selection.up_to(last_train, "_rank", keys, df), "train")
    side = side.when(selection.up_to(last_eval, "_rank", keys, df), "eval").otherwise("unused")
    return df.withColumn("split", side).drop("_rank")


def train_eval_split(
    df: DataFrame, rank_by: Column, *keys: str, train_fraction: float = 0.8, eval_cap: int | None = 50
) -> DataFrame:
    """Exact split by rank: the first ``int(n * fraction)`` rows train, the next ``eval_cap`` evaluate.

    Adds ``split`` (``train``, ``eval`` or ``unused``). ``rank_by`` is a bigint, such as a hash; ``keys`` identify a row and
    break ties. The two borders are found first (see ``selection``); the split itself is a comparison with them, without
    a shuffle.
    """
    ranked = df.withColumn("_rank", rank_by)
    return _sides(ranked, ranked.select("_rank", *keys, F.lit(1).alias("_weight")), keys, train_fraction, eval_cap)


def group_split(
    df: DataFrame, rank_by: Column, *group_keys: str, train_fraction: float = 0.8, eval_cap: int | None = 50
) -> DataFrame:
    """The same with whole groups on one side, such as all windows of a dialogue.

    ``rank_by`` is a function of ``group_keys``. Groups go in its order: the longest start with at most ``int(n * fraction)`` rows
    trains, the longest start of at most ``int(n * fraction) + eval_cap`` rows less those evaluates. So a side is short of its size by less than one group.
    """
    ranked = df.withColumn("_rank", rank_by)
    # Sizes are counted once; a pass over them is small beside one over the rows.
    sizes = stored(ranked.groupBy("_rank", *group_keys).agg(F.count("*").alias("_weight")), "group-sizes")
    return _sides(ranked, sizes, group_keys, train_fraction, eval_cap)


def bucket_split(df: DataFrame, seed: int, *group_keys: str, train_fraction: float = 0.8) -> DataFrame:
    """Approximate split without any shuffle; all rows of a group land on the same side.

    With ``source_file`` as the group, the windows of one dialogue never straddle the border.
    """
    bucket = F.pmod(F.xxhash64(F.lit(seed), *group_keys), F.lit(10_000))
    return df.withColumn("split", F.when(bucket < round(train_fraction * 10_000), "train").otherwise("eval"))
