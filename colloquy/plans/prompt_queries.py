"""Prompt and context assembly; nation, region and part stand in for prompt catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions.text import TOKEN
from colloquy.operators import examples as E
from colloquy.operators import prompts as P
from colloquy.operators import transcripts as X
from colloquy.plans import jobs
from colloquy.plans.example_queries import chat_examples
from colloquy.plans.inputs import CONFIG, SPOKEN, dialogue_turns, numbered_turns, run_config, table
from colloquy.plans.registry import query
from colloquy.plans.transcript_queries import documents_of

TEMPLATE = "Topic {{INITIAL_QUESTION}} / {{PERSONA}} / {{OTHERS}}"
RUBRIC = "Rate {{PAIR_COUNT}} pairs.\n{{ANSWER_FORM}}\n---\n{{PAIRS}}"


def catalogs(spark, sf_dir):
    """Catalog per kind; two catalogs hold an id twice, and the first entry counts."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    part = table(spark, sf_dir, "part")
    questions = part.select(
        F.pmod("p_partkey", F.lit(1000)).cast("int").alias("id"),
        F.concat(F.lit("about "), "p_name", F.lit(" and {{OTHERS}}")).alias("content"),
        F.col("p_name").alias("title"),
        F.col("p_partkey").alias("position"),
    )
    personas = nation.select(
        F.col("n_nationkey").alias("id"),
        F.col("n_name").alias("label"),
        F.concat(F.lit("from "), "n_name").alias("content"),
        F.col("n_nationkey").alias("position"),
    )
    others = region.select(
        F.pmod("r_regionkey", F.lit(3)).alias("id"),
        F.col("r_name").alias("label"),
        F.concat(F.lit("in "), "r_name").alias("content"),
        F.col("r_regionkey").alias("position"),
    )
    return {"question": (questions, "question_id"), "persona": (personas, "persona_id"), "others": (others, "others_id")}


def prompt_config(spark, sf_dir):
    """Ids outside the catalogs are part of it."""
    return run_config(spark, sf_dir).select(
        "dialogue_id",
        (F.col("dialogue_id") % 1100).cast("int").alias("question_id"),
        (F.col("dialogue_id") % 27).cast("int").alias("persona_id"),
        (F.col("dialogue_id") % 4).cast("int").alias("others_id"),
    )


_RESOLVED = (
    CONFIG
    + """, question AS (SELECT p_partkey % 1000 AS id, p_name AS label, 'about ' || p_name || ' and {{OTHERS}}' AS content
  FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey % 1000 ORDER BY p_partkey) = 1)
, persona AS (SELECT n_nationkey AS id, n_name AS label, 'from ' || n_name AS content FROM nation)
, others AS (SELECT r_regionkey % 3 AS id, r_name AS label, 'in ' || r_name AS content
  FROM region QUALIFY row_number() OVER (PARTITION BY r_regionkey % 3 ORDER BY r_regionkey) = 1)
, resolved AS (SELECT dialogue_id, q.label AS question_label, q.content AS question_content, q.id IS NOT NULL AS question_found,
    p.label AS persona_label, p.content AS persona_content, p.id IS NOT NULL AS persona_found,
    o.label AS others_label, o.content AS others_content, o.id IS NOT NULL AS others_found
  FROM config LEFT JOIN question q ON q.id = dialogue_id % 1100 LEFT JOIN persona p ON p.id = dialogue_id % 27
  LEFT JOIN others o ON o.id = dialogue_id % 4)"""
)


@query(f"WITH {_RESOLVED} SELECT * FROM resolved")
def resolve_catalog(spark, sf_dir):
    out = P.resolve_catalog(prompt_config(spark, sf_dir), catalogs(spark, sf_dir))
    return out.drop("question_id", "persona_id", "others_id")


@query(
    f"""WITH {_RESOLVED}, t AS (SELECT *, CASE WHEN dialogue_id % 3 = 0 THEN 'Topic {{{{INITIAL_QUESTION}}}}'
  WHEN dialogue_id % 3 = 1 THEN '{TEMPLATE}' ELSE '{{{{PERSONA}}}} only' END AS template FROM resolved)
SELECT dialogue_id, CASE WHEN question_content IS NULL THEN ''
  WHEN template LIKE '%PERSONA%' AND persona_content IS NULL THEN ''
  WHEN template LIKE '%INITIAL%' AND others_content IS NULL THEN ''
  ELSE replace(replace(replace(template, '{{{{INITIAL_QUESTION}}}}', question_content), '{{{{PERSONA}}}}', coalesce(persona_content, '')),
    '{{{{OTHERS}}}}', coalesce(others_content, '')) END AS prompt FROM t"""
)
def fill_template(spark, sf_dir):
    resolved = P.resolve_catalog(prompt_config(spark, sf_dir), catalogs(spark, sf_dir))
    kind = F.col("dialogue_id") % 3
    template = F.when(kind == 0, "Topic {{INITIAL_QUESTION}}").when(kind == 1, TEMPLATE).otherwise("{{PERSONA}} only")
    prompt = P.fill_template(
        template,
        [
            ("INITIAL_QUESTION", F.col("question_content")),
            ("PERSONA", F.col("persona_content")),
            ("OTHERS", F.col("others_content")),
        ],
        required=[F.col("question_content")],
    )
    return resolved.select("dialogue_id", prompt.alias("prompt"))


def _history_sql(size):
    return f"""string_agg(h.role || '=' || h.text, '|' ORDER BY h.turn) AS history, count(*) AS n
FROM spoken s JOIN spoken h ON h.dialogue_id = s.dialogue_id AND h.turn BETWEEN s.turn - {size - 1} AND s.turn"""


def _joined(messages):
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|")


@query(f"WITH {SPOKEN} SELECT s.dialogue_id, s.turn, {_history_sql(4)} GROUP BY 1, 2")
def history_window(spark, sf_dir):
    out = P.history_window(dialogue_turns(spark, sf_dir), 2)
    return out.select("dialogue_id", "turn", _joined("history").alias("history"), F.size("history").alias("n"))


@query(f"WITH {SPOKEN} SELECT s.dialogue_id, s.turn, {_history_sql(10**6)} GROUP BY 1, 2")
def full_history(spark, sf_dir):
    """A history setting of 0 keeps everything."""
    turns = F.transform("turns", lambda t: F.struct(F.lower(t["speaker"]).alias("role"), t["text"].alias("content")))
    rows = _line_preserving(spark, sf_dir).select("dialogue_id", turns.alias("t"))
    return rows.select("dialogue_id", F.posexplode(P.full_history(F.col("t"))).alias("turn", "h")).select(
        "dialogue_id", "turn", _joined("h").alias("history"), F.size("h").alias("n")
    )


def _line_preserving(spark, sf_dir):
    """Parsed transcripts; texts in the tables have no padding or blank lines, so parsing returns them unchanged."""
    return X.with_turns(documents_of(spark, sf_dir))


# FIFO of four: a queue that starts on a model message falls back to the last message or to nothing.
@query(
    f"""WITH {SPOKEN}, s AS (SELECT dialogue_id, turn, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'model' END AS role, text FROM spoken)
SELECT s.dialogue_id, s.turn,
  CASE WHEN min(h.turn) % 2 = 0 THEN string_agg(h.role || '=' || h.text, '|' ORDER BY h.turn)
       WHEN s.role = 'user' THEN 'user=' || max(s.text) ELSE '' END AS context
FROM s JOIN s h ON h.dialogue_id = s.dialogue_id AND h.turn BETWEEN s.turn - 3 AND s.turn GROUP BY s.dialogue_id, s.turn, s.role"""
)
def fifo_context(spark, sf_dir):
    turns = dialogue_turns(spark, sf_dir).withColumn("role", F.when(F.col("turn") % 2 == 0, "user").otherwise("model"))
    return P.fifo_context(turns, 4).select("dialogue_id", "turn", _joined("context").alias("context"))


_FLAT = """WITH {spoken}, s AS (SELECT dialogue_id, turn, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'model' END AS role, text FROM spoken)
, h AS (SELECT s.dialogue_id, s.turn, s.text, string_agg(CASE WHEN h.role = 'user' THEN '{user}' || '"' || {said} || '"'
     ELSE {model} END, chr(10) ORDER BY h.turn) AS body
  FROM s LEFT JOIN s h ON h.dialogue_id = s.dialogue_id AND h.turn BETWEEN s.turn - 4 AND s.turn - 1 GROUP BY 1, 2, 3)
SELECT dialogue_id, turn, CASE WHEN turn = 0 THEN 'First. ' || '"' || text || '"'
  ELSE 'So far: ' || body || chr(10) || '{user}' || '"' || text || '"' END AS prompt FROM h WHERE turn % 2 = 0"""


def _flattened(turns, **options):
    earlier = P.history_window(turns, 3).withColumn(
        "earlier", F.slice("history", F.greatest(F.size("history") - 4, F.lit(1)), F.least(F.size("history") - 1, F.lit(4)))
    )
    prompt = P.flatten_history(
        F.col("earlier"), F.col("text"), first_preamble=F.lit("First. "), preamble=F.lit("So far: "), **options
    )
    return earlier.filter("turn % 2 = 0").select("dialogue_id", "turn", prompt.alias("prompt"))


@query(_FLAT.format(spoken=SPOKEN, user="User: ", said="h.text", model="'Model: ' || h.text"))
def flatten_history(spark, sf_dir):
    turns = dialogue_turns(spark, sf_dir).withColumn("role", F.when(F.col("turn") % 2 == 0, "user").otherwise("model"))
    return _flattened(turns)


@query(
    _FLAT.format(spoken=SPOKEN, user="Guest: ", said="h.text", model="""'Host: "' || h.text || '"'""")
)
def flatten_history_unquoted(spark, sf_dir):
    """Stored user messages are whole prompts; the quoted input is taken out of them again."""
    user = F.col("turn") % 2 == 0
    stored = F.when(user, F.concat(F.lit('context "x" then "'), "text", F.lit('"'))).otherwise(F.col("text"))
    turns = (
        dialogue_turns(spark, sf_dir)
        .withColumn("role", F.when(user, "user").otherwise("model"))
        .withColumn("said", F.col("text"))
        .withColumn("text", stored)
    )
    out = _flattened(
        turns, user_label="Guest: ", model_label="Host: ", quote_model=True, unquote=True
    )
    # the new input is still wrapped; unwrap it the same way
    return out.withColumn("prompt", F.replace("prompt", F.lit('"context "x" then "'), F.lit('"'))).withColumn(
        "prompt", F.regexp_replace("prompt", '""$', '"')
    )


@query(
    f"""WITH {SPOKEN} SELECT dialogue_id, string_agg(CASE speaker WHEN 'User' THEN 'assistant' ELSE 'user' END
  || '=' || text, '|' ORDER BY turn) AS messages FROM spoken GROUP BY 1"""
)
def flip_roles(spark, sf_dir):
    turns = F.transform("turns", lambda t: F.struct(t["speaker"].alias("role"), t["text"].alias("content")))
    parsed = _line_preserving(spark, sf_dir)
    flipped = P.flip_roles(turns, {"User": "assistant"}, "user")
    return parsed.select("dialogue_id", _joined(flipped).alias("messages"))


@query(
    f"""WITH {CONFIG}, b AS (SELECT dialogue_id, count(*) AS n,
  string_agg(chr(10) || '【ペア' || pair_num || '】' || chr(10) || '口調：' || chr(10) || '論理性：' || chr(10), '' ORDER BY pair_num) AS form,
  string_agg(chr(10) || '【ペア' || pair_num || '】' || chr(10) || 'User: ' || string_split(user_text, chr(10))[1] || chr(10)
    || 'Assistant: ' || replace(assistant_text, chr(10), ' ') || chr(10), '' ORDER BY pair_num) AS block FROM pairs GROUP BY 1)
SELECT dialogue_id, 'Rate ' || n || ' pairs.' || chr(10) || form || chr(10) || '---' || chr(10) || block AS request FROM b"""
)
def judge_request(spark, sf_dir):
    pairs = X.with_pairs(documents_of(spark, sf_dir)).filter(F.size("pairs") > 0)
    request = P.build_judge_request(F.col("pairs"), F.lit(RUBRIC), ["口調：", "論理性："])
    return pairs.select("dialogue_id", request.alias("request"))


_RAW = """CASE WHEN dialogue_id % 9 = 0 THEN text ELSE '<bos><start_of_turn>user' || chr(10) || 'hi<end_of_turn>' || chr(10)
  || '<start_of_turn>model' || chr(10) || CASE WHEN dialogue_id % 4 = 1 THEN 'my model says ' ELSE '' END || text || ' <end_of_turn>' END"""


@query(
    f"""WITH {SPOKEN} SELECT dialogue_id, turn, CASE WHEN dialogue_id % 9 = 0 THEN 'Failed to respond'
  ELSE CASE WHEN dialogue_id % 4 = 1 THEN 'my model says ' ELSE '' END || text END AS answer,
  CASE WHEN dialogue_id % 9 = 0 THEN 'Failed to respond'
  ELSE CASE WHEN dialogue_id % 4 = 1 THEN 'says ' ELSE '' END || text END AS cut_answer FROM spoken"""
)
def extract_completion(spark, sf_dir):
    lead = F.when(F.col("dialogue_id") % 4 == 1, "my model says ").otherwise("")
    raw = F.when(F.col("dialogue_id") % 9 == 0, F.col("text")).otherwise(
        F.concat(
            F.lit("<bos><start_of_turn>user\nhi<end_of_turn>\n<start_of_turn>model\n"), lead, "text", F.lit(" <end_of_turn>")
        )
    )
    return dialogue_turns(spark, sf_dir).select(
        "dialogue_id",
        "turn",
        P.extract_completion(raw).alias("answer"),
        P.extract_completion(raw, cut_role_word=True).alias("cut_answer"),
    )


@query(
    f"""WITH {SPOKEN}, c AS (SELECT dialogue_id, turn, sum(len(regexp_extract_all(text, '{TOKEN}')) + 4)
  OVER (PARTITION BY dialogue_id ORDER BY turn)::BIGINT AS context_tokens FROM spoken)
SELECT dialogue_id, turn, context_tokens, context_tokens > 512 AS over_limit FROM c"""
)
def context_length(spark, sf_dir):
    # tokens are counted before the shuffle, which then carries numbers only
    from colloquy.functions.text import token_count

    sized = numbered_turns(spark, sf_dir, token_count)
    out = P.context_length(sized, content="size", overhead=4, limit=512, count=lambda c: c)
    return out.select("dialogue_id", "turn", "context_tokens", "over_limit")


@query(
    f"""WITH {CONFIG} SELECT dialogue_id, dialogue FROM config c
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.dialogue_id)"""
)
def pending_requests(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("dialogue_id"))
    return P.pending_requests(run_config(spark, sf_dir).select("dialogue_id", "dialogue"), done, "dialogue_id")


@query(
    f"""WITH {SPOKEN} SELECT DISTINCT 'Failed to respond' AS answer, 0 AS n FROM spoken WHERE false
UNION ALL SELECT CASE WHEN count(*) > 0 THEN '' ELSE '' END, count(*) FROM (
  SELECT dialogue_id, s FROM (SELECT dialogue_id, count(*) AS n FROM spoken GROUP BY 1),
  (VALUES {", ".join(f"({s}, {e})" for s, e in E.WINDOWS)}) w(s, e) WHERE e <= n)"""
)
def open_generation_prompts(spark, sf_dir):
    """A rendered example ends with an open model turn, whose completion is still empty."""
    text = E.render_chat(F.col("messages"))
    answers = chat_examples(spark, sf_dir).select(P.extract_completion(text).alias("answer"))
    return answers.groupBy("answer").agg(F.count("*").alias("n"))


def _kinds(spark, sf_dir):
    """The eight catalogs of a run config, from the nation, region and part tables."""
    nation, region, part = (table(spark, sf_dir, t) for t in ("nation", "region", "part"))

    def items(source, key, name, before="", after="", label="label"):
        content = F.concat(F.lit(before), F.col(name), F.lit(after))
        return source.select(
            F.col(key).cast("int").alias("id"), F.col(name).alias(label), content.alias("content"), F.col(key).alias("position")
        )

    return {
        "question": items(part, "p_partkey", "p_name", "about ", label="title"),
        "user_prompt": items(region, "r_regionkey", "r_name", after=": {{INITIAL_QUESTION}} {{PERSONA}} {{OTHERS}} {{TRANSFORM}}", label="title"),
        "persona": items(nation, "n_nationkey", "n_name", "from "),
        "others": items(region, "r_regionkey", "r_name", "in "),
        "transform": items(nation, "n_nationkey", "n_name", "as "),
        "assistant_prompt": items(nation, "n_nationkey", "n_name", after=": {{INITIAL_QUESTION}} {{RESPONSE}} {{UPDATE}}", label="title"),
        "response": items(nation, "n_nationkey", "n_name", "reply "),
        "update": items(region, "r_regionkey", "r_name", "update "),
    }


_IDS = {
    "INITIAL_QUESTION_ID": 1100, "USER_PROMPT_ID": 6, "PERSONA_ID": 26, "OTHERS_ID": 6,
    "TRANSFORM_ID": 25, "ASSISTANT_PROMPT_ID": 25, "RESPONSE_ID": 24, "UPDATE_ID": 5,
}


@query(
    f"""WITH {CONFIG} SELECT dialogue_id,
  CASE WHEN p_name IS NULL OR u.r_name IS NULL OR pe.n_name IS NULL OR o.r_name IS NULL THEN ''
       ELSE u.r_name || ': about ' || p_name || ' from ' || pe.n_name || ' in ' || o.r_name || ' as ' || tr.n_name END AS user_system_prompt,
  CASE WHEN p_name IS NULL THEN '' ELSE a.n_name || ': about ' || p_name || ' reply ' || r.n_name || ' update ' || up.r_name END AS assistant_system_prompt
FROM config LEFT JOIN part ON p_partkey = dialogue_id % 1100 LEFT JOIN region u ON u.r_regionkey = dialogue_id % 6
  LEFT JOIN nation pe ON pe.n_nationkey = dialogue_id % 26 LEFT JOIN region o ON o.r_regionkey = dialogue_id % 6
  LEFT JOIN nation tr ON tr.n_nationkey = dialogue_id % 25 LEFT JOIN nation a ON a.n_nationkey = dialogue_id % 25
  LEFT JOIN nation r ON r.n_nationkey = dialogue_id % 24 LEFT JOIN region up ON up.r_regionkey = dialogue_id % 5
WHERE dialogue = ''"""
)
def dialogue_requests(spark, sf_dir):
    """The request flow end to end: rows without a dialogue, eight lookups, two prompts."""
    config = run_config(spark, sf_dir).select(
        "dialogue_id", "dialogue", *[(F.col("dialogue_id") % n).cast("int").alias(c) for c, n in _IDS.items()]
    )
    out = jobs.dialogue_requests(config, _kinds(spark, sf_dir))
    return out.select("dialogue_id", "user_system_prompt", "assistant_system_prompt")


@query(
    f"""WITH {CONFIG}, b AS (SELECT dialogue_id, count(*) AS n,
  string_agg(chr(10) || '【ペア' || pair_num || '】' || chr(10) || 'User: ' || string_split(user_text, chr(10))[1] || chr(10)
    || 'Assistant: ' || replace(assistant_text, chr(10), ' ') || chr(10), '' ORDER BY pair_num) AS block FROM pairs GROUP BY 1)
SELECT dialogue_id, coalesce(n, 0) || ' pairs' || coalesce(block, '') AS request, NULL::VARCHAR AS answer
FROM rounds LEFT JOIN b USING (dialogue_id)
WHERE dialogue_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = dialogue_id)
UNION ALL SELECT dialogue_id, NULL, 'Verdict' FROM rounds WHERE dialogue_id % 5 = 0"""
)
def open_judge_requests(spark, sf_dir):
    """The rating flow up to the judge: rated and evaluated transcripts are left out, their answers picked up."""
    evaluated = F.when(F.col("dialogue_id") % 5 == 0, X.attach_evaluation(F.col("content"), F.lit("Verdict")))
    documents = documents_of(spark, sf_dir).withColumn("content", F.coalesce(evaluated, "content"))
    store = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("dialogue_id"), F.col("quality").cast("string").alias("score")
    )
    requests = jobs.judge_requests(documents, store, "{{PAIR_COUNT}} pairs{{PAIRS}}", [], "dialogue_id")
    answers = jobs.embedded_answers(documents, "dialogue_id")
    return requests.select("dialogue_id", "request", F.lit(None).cast("string").alias("answer")).unionByName(
        answers.select("dialogue_id", F.lit(None).cast("string").alias("request"), "answer")
    )
