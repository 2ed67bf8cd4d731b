"""Templates compiled to columns, against the texts they stand for."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators import examples as E
from colloquy.operators.templates import compile_template

TURNS = """{{ bos_token }}{% for message in messages %}{% if message['role'] == 'assistant' %}{% set role = 'model' %}{% else %}{% set role = message['role'] %}{% endif %}{{ '<start_of_turn>' + role + '\n' + message['content'] | trim + '<end_of_turn>\n' }}{% endfor %}{% if add_generation_prompt %}{{ '<start_of_turn>model\n' }}{% endif %}"""
INSTRUCTIONS = """
{%- if messages[0].role == "system" -%}
  {%- set rules = "<<" ~ messages[0].content ~ ">> " -%}
  {%- set rest = messages[1:] -%}
{%- else -%}
  {%- set rules = "" -%}
  {%- set rest = messages -%}
{%- endif -%}
{%- for m in rest -%}
  {%- if m.role == "user" -%}
    {{- "[INST] " -}}{%- if loop.first -%}{{- rules -}}{%- endif -%}{{- m.content + " [/INST]" -}}
  {%- elif m.role == "assistant" and not loop.last -%}
    {{- " " + m.content + "</s>" -}}
  {%- else -%}
    {{- " " ~ loop.index ~ "/" ~ loop.length ~ " " ~ m.content -}}
  {%- endif -%}
{%- endfor -%}"""

SCHEMA = "i int, messages array<struct<role: string, content: string>>"
CHATS = [
    [("user", " hi "), ("assistant", "yes\n"), ("user", "b")],
    [("system", "be kind"), ("user", "q"), ("assistant", "a")],
    [("user", None)],
    [],
]


@pytest.fixture(scope="module")
def chats(spark):
    return spark.createDataFrame(list(enumerate(CHATS)), SCHEMA)


def rendered(df, column):
    return {r["i"]: r["t"] for r in df.select("i", column.alias("t")).collect()}


def test_turn_marks(chats):
    found = rendered(chats, compile_template(TURNS)(messages=F.col("messages"), bos_token="<bos>", add_generation_prompt=True))
    for i, chat in enumerate(CHATS):
        body = "".join(f"<start_of_turn>{'model' if r == 'assistant' else r}\n{(c or '').strip()}<end_of_turn>\n" for r, c in chat)
        assert found[i] == f"<bos>{body}<start_of_turn>model\n"
    same = compile_template(TURNS)(messages=F.col("messages"), bos_token=E.BOS, add_generation_prompt=False)
    built_in = E.render_chat(F.transform("messages", lambda m: F.struct(F.when(m["role"] == "assistant", "model").otherwise(m["role"]).alias("role"), m["content"].alias("content"))), add_generation_prompt=False)
    assert {i: t for i, t in rendered(chats, same).items() if i != 2} == {i: t for i, t in rendered(chats, built_in).items() if i != 2}


def test_instructions(chats):
    found = rendered(chats, compile_template(INSTRUCTIONS)(messages=F.col("messages")))
    assert found == {0: "[INST]  hi  [/INST] yes\n</s>[INST] b [/INST]", 1: "[INST] <<be kind>> q [/INST] 2/2 a", 2: "[INST]  [/INST]", 3: ""}


def test_values(chats):
    one = chats.filter("i = 0")
    cases = {
        "{{ 1 + 'a' ~ 2 }}": "1a2", "{{ 'x' in 'axb' }}": "true", "{{ not (1 == 2 or 2 < 1) and 3 >= 3 }}": "true", "{# note #}a\n": "a\n",
        "{{ messages[1]['content'] | trim }}|{{ messages[9].role }}|": "yes||", "{{ 5 % 2 }}{{ \"it's\" }}{{ 'tab\\t' }}": "1it's\ttab\t"[:1] + "it'stab\t",
        "a\n  {% if flag %}\nb\n  {% endif %}\nc": "a\nb\nc", "a {%- if flag -%} b {%- endif -%} c": "abc",
    }
    for template, want in cases.items():
        assert rendered(one, compile_template(template)(messages=F.col("messages"), flag=True))[0] == want, template
    assert rendered(one, compile_template("a\n {% if flag %}b{% endif %}\n", trim_blocks=False)(flag=F.lit(True)))[0] == "a\n b\n"


def test_no_function_for_each_row(chats):
    column = compile_template(TURNS)(messages=F.col("messages"), bos_token="", add_generation_prompt=True)
    plan = chats.select(column)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_an_exception_fails_the_query(chats):
    template = compile_template("{% for m in messages %}{% if m.role == 'system' %}{{ raise_exception('no system role') }}{% endif %}{{ m.role }}{% endfor %}")
    assert rendered(chats.filter("i = 0"), template(messages=F.col("messages")))[0] == "userassistantuser"
    with pytest.raises(Exception, match="no system role"):
        rendered(chats, template(messages=F.col("messages")))


@pytest.mark.parametrize("template", ["{% if a %}", "{% for a in b %}", "{% while a %}", "{{ a b }}", "{{ 'a }}", "{{ a | upper }}", "{{ (1 }}", "{% endif %}", "{{ }}", "{{ a[ }}"])
def test_what_a_template_may_not_hold(template):
    with pytest.raises((ValueError, IndexError)):
        compile_template(template)(a=1)


def test_unknown_names():
    with pytest.raises(ValueError, match="does not know"):
        compile_template("{{ eos }}")(bos="x")
