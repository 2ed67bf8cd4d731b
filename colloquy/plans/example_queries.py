"""Training-example preparation over ``conversations`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions.text import TOKEN, first_tokens_pattern, token_count
from colloquy.operators import examples as E
from colloquy.operators import patterns as K
from colloquy.operators import transcripts as X
from colloquy.operators.templates import compile_template
from colloquy.plans.inputs import SPOKEN, dialogue_turns, spread, table
from colloquy.plans.jobs import prepare_examples
from colloquy.plans.registry import query
from colloquy.plans.transcript_queries import CLEAN_TEXT, documents_of

PREFIX = "Answer briefly. "
# Sentence mark and patterns that occur in the tables' Latin text.
LATIN_END = "."
LATIN_PATTERNS = ("th", "en", "ion", "sch", "é", "的", "the ")

# The reference windows start at the third utterance; conversations here have up to eight.
_WINDOWS_SQL = "(VALUES " + ", ".join(f"({s}, {e})" for s, e in E.WINDOWS) + ") w(s, e)"


def _chat(windows):
    """SQL: one row per message of every complete window."""
    return f"""sized AS (SELECT *, count(*) OVER (PARTITION BY dialogue_id) AS n FROM spoken), chat AS (
  SELECT dialogue_id::VARCHAR AS source_file, s || '-' || e AS extract_range, turn + 1 - s AS pos,
         CASE WHEN speaker = 'User' THEN 'user' ELSE 'model' END AS role,
         CASE WHEN turn + 1 = s THEN '{PREFIX}' ELSE '' END || replace({{text}}, chr(10), '\\n') AS content
  FROM sized, {windows} WHERE turn + 1 BETWEEN s AND e AND e <= n)"""


_CHAT = _chat(_WINDOWS_SQL).format(text="text")
_CHAT_PARSED = _chat(_WINDOWS_SQL).format(text=CLEAN_TEXT)
_MESSAGES = "SELECT source_file, extract_range, pos, role, content FROM chat"


def _long(chat):
    return chat.select("source_file", "extract_range", F.posexplode("messages").alias("pos", "m")).select(
        "source_file", "extract_range", "pos", "m.*"
    )


def chat_examples(spark, sf_dir, windows=E.WINDOWS):
    cut = E.windows_from_turns(dialogue_turns(spark, sf_dir), "dialogue_id", windows=windows)
    return E.to_chat(cut, "dialogue_id", PREFIX)


@query(f"WITH {SPOKEN}, {_CHAT} {_MESSAGES}")
def chat_windows(spark, sf_dir):
    return _long(chat_examples(spark, sf_dir))


@query(f"WITH {SPOKEN}, {_CHAT_PARSED} {_MESSAGES}")
def chat_windows_from_transcripts(spark, sf_dir):
    parsed = X.with_turns(documents_of(spark, sf_dir))
    return _long(E.to_chat(E.extract_windows(parsed, "dialogue_id"), "dialogue_id", PREFIX))


# Whole conversations as one example each, with flaws put in.
WHOLE = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 5), (3, 8), (1, 8))
_WHOLE_SQL = "(VALUES " + ", ".join(f"({s}, {e})" for s, e in WHOLE) + ") w(s, e)"
_FLAWED = (
    _chat(_WHOLE_SQL).format(text="text")
    + """, flawed AS (
  SELECT source_file, extract_range, pos,
         CASE WHEN source_file::BIGINT % 11 = 3 AND pos = 0 THEN 'system' ELSE role END AS role,
         CASE WHEN source_file::BIGINT % 13 = 5 AND pos = 1 THEN NULL ELSE content END AS content
  FROM chat), examples AS (
  SELECT source_file, extract_range, count(*) AS n,
         bool_and(role IN ('user', 'model') AND content IS NOT NULL) AS valid,
         bool_and(role = CASE WHEN pos % 2 = 0 THEN 'user' ELSE 'model' END) FILTER (pos < n_all // 2 * 2) AS ordered,
         '<bos>' || string_agg('<start_of_turn>' || role || chr(10) || trim(content) || '<end_of_turn>' || chr(10), '' ORDER BY pos)
           FILTER (pos < n_all // 2 * 2) || '<start_of_turn>model' || chr(10) AS text
  FROM (SELECT *, count(*) OVER (PARTITION BY source_file, extract_range) AS n_all FROM flawed) GROUP BY 1, 2)
, judged AS (SELECT *, CASE WHEN NOT valid THEN 'format' WHEN n < 2 THEN 'empty' WHEN NOT ordered THEN 'order' END AS early
  FROM examples)
, counted AS (SELECT *, CASE WHEN early IS NULL THEN len(regexp_extract_all(text, '"""
    + TOKEN
    + """')) END AS n_tokens FROM judged)
, classified AS (SELECT source_file, extract_range, CASE WHEN early IS NULL THEN text END AS text, n_tokens,
  coalesce(early, CASE WHEN n_tokens > 256 THEN 'length' END) AS reject_reason FROM counted) """
)


def flawed_examples(spark, sf_dir):
    number = F.col("source_file").cast("bigint")
    return chat_examples(spark, sf_dir, WHOLE).withColumn(
        "messages",
        F.transform(
            "messages",
            lambda m, i: F.struct(
                F.when((number % 11 == 3) & (i == 0), "system").otherwise(m["role"]).alias("role"),
                F.when(~((number % 13 == 5) & (i == 1)), m["content"]).alias("content"),
            ),
        ),
    )


def _classified(spark, sf_dir):
    return E.classify_examples(flawed_examples(spark, sf_dir))


@query(f"WITH {SPOKEN}, {_FLAWED} SELECT source_file, extract_range, n_tokens, reject_reason FROM classified")
def example_checks(spark, sf_dir):
    return _classified(spark, sf_dir).select("source_file", "extract_range", "n_tokens", "reject_reason")


@query(f"WITH {SPOKEN}, {_FLAWED} SELECT source_file, extract_range, valid, valid AND ordered AS ordered FROM examples")
def message_order(spark, sf_dir):
    checked = flawed_examples(spark, sf_dir).withColumn("valid", E.valid_messages(F.col("messages")))
    return checked.select(
        "source_file",
        "extract_range",
        "valid",
        F.when(F.col("valid"), E.alternating(F.col("messages"))).otherwise(False).alias("ordered"),
    )


# Two unlike templates, in the language of tokenizers.
MARKED = (
    "{{ bos_token }}{% for m in messages %}{% if m['role'] == 'model' %}{% set role = 'assistant' %}{% else %}{% set role = m['role'] %}{% endif %}"
    "{{ '<|' + role + '|>\n' + m['content'] | trim + '\n' }}{% endfor %}{% if add_generation_prompt %}{{ '<|assistant|>\n' }}{% endif %}"
)
BRACKETED = (
    "{%- for m in messages -%}{%- if m.role == 'user' -%}{{- '[INST] ' ~ loop.index ~ ' of ' ~ loop.length ~ ': ' ~ m.content ~ ' [/INST]' -}}"
    "{%- else -%}{{- ' ' ~ m.content -}}{%- if not loop.last -%}</s>{%- endif -%}{%- endif -%}{%- endfor -%}"
)


@query(
    f"""WITH {SPOKEN}, {_CHAT}, sized_chat AS (SELECT *, count(*) OVER (PARTITION BY source_file, extract_range) AS n_all FROM chat)
SELECT source_file, extract_range, '<s>' || string_agg('<|' || CASE role WHEN 'model' THEN 'assistant' ELSE role END || '|>' || chr(10) || trim(content) || chr(10), '' ORDER BY pos)
    || '<|assistant|>' || chr(10) AS marked,
  string_agg(CASE WHEN role = 'user' THEN '[INST] ' || (pos + 1) || ' of ' || n_all || ': ' || content || ' [/INST]'
    ELSE ' ' || content || CASE WHEN pos + 1 < n_all THEN '</s>' ELSE '' END END, '' ORDER BY pos) AS bracketed
FROM sized_chat GROUP BY 1, 2"""
)
def templated_chat(spark, sf_dir):
    """Examples rendered by compiled chat templates."""
    messages = F.col("messages")
    return chat_examples(spark, sf_dir).select(
        "source_file",
        "extract_range",
        compile_template(MARKED)(messages=messages, bos_token="<s>", add_generation_prompt=True).alias("marked"),
        compile_template(BRACKETED)(messages=messages).alias("bracketed"),
    )


@query(f"WITH {SPOKEN}, {_FLAWED} SELECT source_file, extract_range, text FROM classified WHERE text IS NOT NULL")
def chat_text(spark, sf_dir):
    return _classified(spark, sf_dir).filter("text is not null").select("source_file", "extract_range", "text")


@query(
    f"""WITH {SPOKEN}, {_FLAWED} SELECT coalesce(reject_reason, 'kept') AS reject_reason, count(*) AS n
FROM classified GROUP BY 1"""
)
def reject_report(spark, sf_dir):
    return E.reject_report(_classified(spark, sf_dir))


@query(
    f"""WITH {SPOKEN}, {_FLAWED}, t AS (SELECT len(regexp_extract_all(text, '{TOKEN}')) AS n FROM documents)
SELECT 'documents' AS corpus, count(*) AS n_rows, count(n) AS n_sized, min(n) AS min_size, max(n) AS max_size,
       sum(n)::BIGINT AS total_size FROM t
UNION ALL SELECT 'examples', count(*), count(n_tokens), min(n_tokens), max(n_tokens), sum(n_tokens)::BIGINT FROM classified"""
)
def example_profile(spark, sf_dir):
    documents = E.profile_examples(table(spark, sf_dir, "documents"), token_count(F.col("text")))
    examples = E.profile_examples(_classified(spark, sf_dir), F.col("n_tokens"))
    return documents.select(F.lit("documents").alias("corpus"), "*").unionByName(
        examples.select(F.lit("examples").alias("corpus"), "*")
    )


@query(
    f"""WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '{TOKEN}')) AS n_tokens FROM documents)
SELECT doc_id, n_tokens FROM t WHERE n_tokens <= 256"""
)
def token_budget(spark, sf_dir):
    return E.within_token_budget(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "n_tokens")


# SQL of the padded ids: id of a token is a number from its md5, mapped behind the reserved ids.
_IDS = f"""ids AS (SELECT doc_id, [{E.BOS_ID}] || list_transform(regexp_extract_all(text, '{TOKEN}'),
    lambda t: {E.RESERVED_IDS} + ('0x' || md5(t)[1:8])::BIGINT % {E.VOCAB - E.RESERVED_IDS}) AS all_ids FROM documents)"""


@query(
    f"""WITH {_IDS}, cut AS (SELECT doc_id, all_ids[1:{E.MAX_TOKENS}] AS kept FROM ids)
SELECT doc_id, len(kept) AS n_real, {E.MAX_TOKENS} AS n_ids, list_sum(kept)::BIGINT AS id_sum,
       array_to_string(kept, ' ') || repeat(' 0', {E.MAX_TOKENS} - len(kept)) AS ids FROM cut"""
)
def tokenize_pad(spark, sf_dir):
    """Truncated and padded to the model length, which is what the operator is for."""
    padded = E.tokenize_pad(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return padded.select(
        "doc_id",
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"),
        F.size("input_ids").alias("n_ids"),
        F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"),
        F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ").alias("ids"),
    )


_PATTERN_VALUES = "(VALUES " + ", ".join(f"('{p}')" for p in LATIN_PATTERNS) + ") p(pattern)"


@query(
    f"""WITH s AS (SELECT doc_id, unnest(string_split(text, '{LATIN_END}')) AS sentence FROM documents)
, c AS (SELECT doc_id, sentence FROM s WHERE trim(sentence, ' ' || chr(9) || chr(10) || chr(13)) <> '')
SELECT pattern, count(*) FILTER (contains(sentence, pattern)) AS n_sentences,
       count(DISTINCT doc_id) FILTER (contains(sentence, pattern)) AS n_rows
FROM c, {_PATTERN_VALUES} GROUP BY 1"""
)
def pattern_hits(spark, sf_dir):
    documents = spread(table(spark, sf_dir, "documents").select("text"))
    return E.pattern_hits(documents, patterns=LATIN_PATTERNS, end=LATIN_END)


_WORDS = r"""pattern_table AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS pattern FROM benchmark)"""


def word_patterns(spark, sf_dir):
    """All words of ``benchmark``: a table of patterns."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return table(spark, sf_dir, "benchmark").select(F.explode(words).alias("pattern")).distinct()


@query(
    f"""WITH {_WORDS}, s AS (SELECT doc_id, unnest(string_split(text, '{LATIN_END}')) AS sentence, generate_subscripts(string_split(text, '{LATIN_END}'), 1) AS n FROM documents)
, c AS (SELECT * FROM s WHERE trim(sentence, ' ' || chr(9) || chr(10) || chr(13)) <> '')
, hits AS (SELECT pattern, doc_id, n FROM c JOIN pattern_table ON contains(sentence, pattern))
SELECT pattern, count(doc_id) AS n_sentences, count(DISTINCT doc_id) AS n_rows FROM pattern_table LEFT JOIN hits USING (pattern) GROUP BY 1"""
)
def pattern_table_hits(spark, sf_dir):
    """The words of one table looked for in the sentences of another."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return K.table_hits(documents, word_patterns(spark, sf_dir), ["doc_id"], end=LATIN_END)


def _tokens_sql(text):
    return f"len(regexp_extract_all({text}, '{TOKEN}'))"


def _mask_sql(before, source="documents", ctes="", kept="0"):
    return f"""WITH {ctes} parts AS (
  SELECT doc_id, unnest(string_split(text, '{LATIN_END}')) AS sentence,
         generate_subscripts(string_split(text, '{LATIN_END}'), 1) AS pos FROM {source})
, sentences AS (
  SELECT doc_id, sentence, {_tokens_sql("sentence")} AS size,
         coalesce(sum({_tokens_sql(f"sentence || '{LATIN_END}'")}) OVER (PARTITION BY doc_id ORDER BY pos
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM parts WHERE trim(sentence, ' ' || chr(9) || chr(10) || chr(13)) <> '')
, spans AS (
  SELECT doc_id, start + {before} - 2 AS lo, start + {before} + {_tokens_sql("pattern")} + 2 AS hi
  FROM sentences, {_PATTERN_VALUES} WHERE contains(sentence, pattern))
, marked AS (
  SELECT DISTINCT doc_id, i FROM spans, LATERAL (SELECT unnest(generate_series(greatest(lo, 0)::BIGINT, least(hi, {E.MAX_TOKENS})::BIGINT - 1)) AS i)
  UNION SELECT doc_id, unnest([0, {E.MAX_TOKENS - 1}] || generate_series(0, {kept})) FROM {source})
SELECT doc_id, count(*) AS n_marked, sum(i)::BIGINT AS position_sum, sum(i * i)::BIGINT AS square_sum FROM marked GROUP BY 1"""


def _span_mask(spark, sf_dir, anchor):
    blank = F.array_repeat(F.lit(0), E.MAX_TOKENS)
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("attention_mask", blank)
    return _marked(E.pattern_span_mask(documents, patterns=LATIN_PATTERNS, end=LATIN_END, anchor=anchor))


def _marked(masked):
    positions = F.filter(
        F.transform("attention_mask", lambda m, i: F.when(m == 1, i.cast("bigint"))), lambda i: i.isNotNull()
    )
    zero = F.lit(0).cast("bigint")
    return masked.select("doc_id", positions.alias("p")).select(
        "doc_id",
        F.size("p").alias("n_marked"),
        F.aggregate("p", zero, lambda a, i: a + i).alias("position_sum"),
        F.aggregate("p", zero, lambda a, i: a + i * i).alias("square_sum"),
    )


@query(_mask_sql(f"size - {_tokens_sql('pattern')}"))
def pattern_span_mask(spark, sf_dir):
    return _span_mask(spark, sf_dir, "tail")


@query(_mask_sql(_tokens_sql("string_split(sentence, pattern)[1]")))
def pattern_span_mask_actual(spark, sf_dir):
    return _span_mask(spark, sf_dir, "actual")


@query(_mask_sql(f"size - {_tokens_sql('pattern')}").replace(_PATTERN_VALUES, "pattern_table").replace("WITH ", f"WITH {_WORDS},", 1))
def pattern_table_mask(spark, sf_dir):
    """The mask of all words of a table."""
    blank = F.array_repeat(F.lit(0), E.MAX_TOKENS)
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("attention_mask", blank)
    return _marked(K.table_span_mask(documents, word_patterns(spark, sf_dir), ["doc_id"], end=LATIN_END))


_DECODED = f"""first AS (SELECT doc_id, regexp_extract(text, '{first_tokens_pattern(E.MAX_TOKENS - 1)}') AS p FROM documents)
, decoded AS (SELECT doc_id, {_tokens_sql("p")} AS kept,
  '{E.BOS_MARK}' || p || repeat('{E.PAD_MARK}', {E.MAX_TOKENS - 1} - {_tokens_sql("p")}) AS text FROM first),"""


@query(_mask_sql(f"size - {_tokens_sql('pattern')}", "decoded", _DECODED, "kept"))
def tokenize_mask(spark, sf_dir):
    """Ids and mask from one tokenisation of the text that the ids stand for."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _marked(E.tokenize_mask(documents, patterns=LATIN_PATTERNS, end=LATIN_END))


@query("SELECT doc_id, n_chars FROM documents")
def seeded_shuffle(spark, sf_dir):
    return E.seeded_shuffle(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 42, "doc_id")


def md5_rank(*keys: str):
    """60-bit number that SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 15), 16, 10).cast("bigint")


@query(
    """WITH r AS (SELECT doc_id, ('0x' || md5(doc_id::VARCHAR)[1:15])::BIGINT AS h FROM documents)
, o AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) - 1 AS pos, count(*) OVER () AS n FROM r)
SELECT doc_id, CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.8::DOUBLE) + 50 THEN 'eval'
  ELSE 'unused' END AS split FROM o"""
)
def train_eval_split(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id")
    return E.train_eval_split(documents, md5_rank("doc_id"), "doc_id")


@query(
    f"""WITH {SPOKEN}, {_CHAT}, rows AS (SELECT DISTINCT source_file, extract_range FROM chat)
, sizes AS (SELECT source_file, ('0x' || md5(source_file)[1:15])::BIGINT AS h, count(*) AS n FROM rows GROUP BY 1)
, ordered AS (SELECT source_file, sum(n) OVER (ORDER BY h, source_file) AS through, sum(n) OVER () AS total FROM sizes)
SELECT source_file, extract_range, CASE WHEN through <= floor(total * 0.8::DOUBLE) THEN 'train'
  WHEN through <= floor(total * 0.8::DOUBLE) + 50 THEN 'eval' ELSE 'unused' END AS split
FROM rows JOIN ordered USING (source_file)"""
)
def group_split(spark, sf_dir):
    """All windows of a dialogue on one side."""
    windows = chat_examples(spark, sf_dir).select("source_file", "extract_range")
    return E.group_split(windows, md5_rank("source_file"), "source_file")


@query("SELECT source, 1 AS n_sides, count(*) AS n FROM documents GROUP BY 1")
def bucket_split(spark, sf_dir):
    """Every source on one side only."""
    split = E.bucket_split(table(spark, sf_dir, "documents").select("doc_id", "source"), 42, "source")
    return split.groupBy("source").agg(
        F.count_distinct("split").alias("n_sides"), F.count("*").alias("n")
    )


@query(
    f"""WITH {SPOKEN}, {_CHAT_PARSED}, g AS (SELECT source_file, extract_range, count(*) AS n,
  bool_and(role = CASE WHEN pos % 2 = 0 THEN 'user' ELSE 'model' END) AS ordered,
  '<bos>' || string_agg('<start_of_turn>' || role || chr(10) || trim(content) || '<end_of_turn>' || chr(10), '' ORDER BY pos)
  || '<start_of_turn>model' || chr(10) AS text FROM chat GROUP BY 1, 2)
, c AS (SELECT *, {_tokens_sql("text")} AS n_tokens FROM g WHERE ordered)
SELECT source_file, extract_range, text, n_tokens FROM c WHERE n_tokens <= 256"""
)
def prepared_examples(spark, sf_dir):
    """The preparation flow end to end, from transcripts to usable examples."""
    documents = documents_of(spark, sf_dir).withColumn("source", F.col("dialogue_id").cast("string"))
    prepared = prepare_examples(documents, "source", prefix=PREFIX)
    return prepared.filter("reject_reason is null").select("source_file", "extract_range", "text", "n_tokens")
