"""Chat templates compiled to column expressions: rendering stays in the JVM, without a function for each row.

A template is text with ``{{ value }}``, ``{% for m in messages %}``, ``{% if %}``/``{% elif %}``/``{% else %}`` and ``{% set name = value %}``, the
part of the usual template language that chat templates of tokenizers are made of. Values are strings, whole numbers, names,
fields (``m.role``, ``m['role']``), list items (``messages[0]``, ``messages[1:]``), ``+`` and ``~``, ``%``, comparisons, ``and``, ``or``, ``not``, ``in`` (a string), the filter
``trim``, ``loop.index``, ``index0``, ``first``, ``last``, ``length``, and ``raise_exception(text)``, which fails the query. A dash at a tag strips
the white space next to it; a line feed right behind a ``{% %}`` tag and blanks in front of it on its line go if ``trim_blocks`` is set,
as tokenizers set it.

A loop becomes a transform of the array of messages, a condition a case expression, and a name set in a branch a case
expression of its old and new value. What a template does not know raises ``ValueError`` when it is compiled. Null fields
are written as empty strings.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import py_strip

_TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~|().\[\]:%<>,]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}

Env = dict[str, Any]
Value = Callable[[Env], Any]
Node = Callable[[Env, list], None]


def _pieces(template: str, trim_blocks: bool) -> Iterator[tuple[str, str]]:
    """``(kind, body)`` of texts, values and statements, with white space taken off where tags say so."""
    parts = _TAG.split(template)
    for i, part in enumerate(parts):
        if i % 2:
            if not part.startswith("{#"):
                yield ("value" if part.startswith("{{") else "tag"), part[2:-2].strip("-").strip()
            continue
        before, after = (parts[i - 1] if i else ""), (parts[i + 1] if i + 1 < len(parts) else "")
        if before.endswith(("-}}", "-%}")):
            part = part.lstrip()
        elif trim_blocks and before.endswith(("%}", "#}")):
            part = part.removeprefix("\n")
        if after.startswith(("{{-", "{%-")):
            part = part.rstrip()
        elif trim_blocks and after.startswith(("{%", "{#")):
            part = re.sub(r"(?:(?<=\n)|\A)[ \t]+\Z", "", part)
        if part:
            yield "text", part


class _Expression:
    """Reads one expression and gives a function from names to its value."""

    def __init__(self, text: str):
        self.text = text
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            found = _TOKEN.match(text, at)
            if not found:
                raise ValueError(f"cannot read {text[at:]!r} in a template")
            self.tokens.append(next((k, v) for k, v in zip(("string", "number", "name", "sign"), found.groups()) if v is not None))
            at = found.end()
        self.at = 0

    def read(self) -> Value:
        value = self._binary(0)
        if self.at < len(self.tokens):
            raise ValueError(f"cannot read {self.text!r} in a template")
        return value

    def _next(self, *texts: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in texts:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _need(self, text: str) -> None:
        if not self._next(text):
            raise ValueError(f"{text!r} is missing in {self.text!r}")

    _LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "~"), ("%",))

    def _binary(self, level: int) -> Value:
        if level == len(self._LEVELS):
            return self._filtered()
        if self._LEVELS[level] == ("not",):
            if self._next("not"):
                inner = self._binary(level)
                return lambda env: ~_truth(inner(env))
            return self._binary(level + 1)
        left = self._binary(level + 1)
        while sign := self._next(*self._LEVELS[level]):
            left = self._combined(sign, left, self._binary(level + 1))
        return left

    @staticmethod
    def _combined(sign: str, left: Value, right: Value) -> Value:
        apply = {
            "or": lambda a, b: _truth(a) | _truth(b),
            "and": lambda a, b: _truth(a) & _truth(b),
            "==": lambda a, b: _column(a).eqNullSafe(_column(b)),
            "!=": lambda a, b: ~_column(a).eqNullSafe(_column(b)),
            "<": lambda a, b: _column(a) < _column(b),
            "<=": lambda a, b: _column(a) <= _column(b),
            ">": lambda a, b: _column(a) > _column(b),
            ">=": lambda a, b: _column(a) >= _column(b),
            "in": lambda a, b: F.contains(_text(b), _text(a)),
            "+": lambda a, b: F.concat(_text(a), _text(b)),
            "~": lambda a, b: F.concat(_text(a), _text(b)),
            "%": lambda a, b: _column(a) % _column(b),
        }[sign]
        return lambda env: apply(left(env), right(env))

    def _filtered(self) -> Value:
        value = self._member()
        while self._next("|"):
            self._need("trim")
            value = (lambda inner: lambda env: py_strip(_text(inner(env))))(value)
        return value

    def _member(self) -> Value:
        value = self._primary()
        while True:
            if self._next("."):
                value = _field(value, self._take("name"))
            elif self._next("["):
                if self.tokens[self.at][0] == "string":
                    value = _field(value, _unquoted(self._take("string")))
                else:
                    number = int(self._take("number"))
                    value = _slice(value, number) if self._next(":") else _item(value, number)
                self._need("]")
            else:
                return value

    def _take(self, kind: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise ValueError(f"a {kind} is missing in {self.text!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def _primary(self) -> Value:
        if self._next("("):
            value = self._binary(0)
            self._need(")")
            return value
        if self.at >= len(self.tokens):
            raise ValueError(f"a value is missing in {self.text!r}")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return lambda env: F.lit(_unquoted(text))
        if kind == "number":
            return lambda env: F.lit(int(text))
        if kind != "name":
            raise ValueError(f"cannot read {self.text!r} in a template")
        if text in ("true", "True", "false", "False"):
            return lambda env: F.lit(text in ("true", "True"))
        if text == "raise_exception":
            self._need("(")
            message = self._binary(0)
            self._need(")")
            return lambda env: F.raise_error(_text(message(env))).cast("string")
        return lambda env: _known(env, text)


def _unquoted(literal: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), literal[1:-1], flags=re.S)


def _known(env: Env, name: str) -> Any:
    if name not in env:
        raise ValueError(f"a template does not know {name!r}")
    return env[name]


def _column(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _text(value: Any) -> Column:
    return F.coalesce(_column(value).cast("string"), F.lit(""))


def _truth(value: Any) -> Column:
    return F.coalesce(_column(value), F.lit(False))


def _field(value: Value, name: str) -> Value:
    def read(env: Env) -> Any:
        held = value(env)
        if isinstance(held, Mapping):
            return _known(held, name)
        return held[name]

    return read


def _item(value: Value, number: int) -> Value:
    return lambda env: F.get(value(env), F.lit(number))


def _slice(value: Value, start: int) -> Value:
    return lambda env: F.slice(value(env), start + 1, F.greatest(F.size(value(env)) - start, F.lit(0)))


def _joined(parts: list) -> Column:
    return F.concat(F.lit(""), *parts)


def _run(nodes: list[Node], env: Env) -> list:
    out: list = []
    for node in nodes:
        node(env, out)
    return out


def _loop(name: str, over: Value, body: list[Node]) -> Node:
    def emit(env: Env, out: list) -> None:
        items = over(env)

        def each(item: Column, i: Column) -> Column:
            size = F.size(items)
            loop = {"index0": i, "index": i + 1, "first": i == 0, "last": i == size - 1, "length": size}
            return _joined(_run(body, {**env, name: item, "loop": loop}))

        out.append(F.coalesce(F.array_join(F.transform(items, each), ""), F.lit("")))

    return emit


def _case(branches: list[tuple[Value | None, list[Node]]]) -> Node:
    def emit(env: Env, out: list) -> None:
        conditions, envs, texts = [], [], []
        for condition, body in branches:
            conditions.append(F.lit(True) if condition is None else _truth(condition(env)))
            own = dict(env)
            texts.append(_joined(_run(body, own)))
            envs.append(own)

        def chosen(values: list, otherwise: Any) -> Column:
            picked = F.when(conditions[0], values[0])
            for condition, value in zip(conditions[1:], values[1:]):
                picked = picked.when(condition, value)
            return picked.otherwise(otherwise)

        out.append(chosen(texts, F.lit("")))
        for name in {n for own in envs for n in own if own[n] is not env.get(n)}:
            old = _column(env[name]) if name in env else F.lit(None)
            env[name] = chosen([_column(own[name]) if name in own else F.lit(None) for own in envs], old)

    return emit


def _set(name: str, value: Value) -> Node:
    def emit(env: Env, out: list) -> None:
        env[name] = value(env)

    return emit


def _parsed(pieces: list[tuple[str, str]], until: tuple[str, ...] = ()) -> tuple[list[Node], str]:
    """Nodes up to a tag that starts with one of ``until``, and that tag."""
    nodes: list[Node] = []
    while pieces:
        kind, body = pieces.pop(0)
        word, _, rest = body.partition(" ")
        if kind == "text":
            nodes.append((lambda text: lambda env, out: out.append(F.lit(text)))(body))
        elif kind == "value":
            nodes.append((lambda value: lambda env, out: out.append(_text(value(env))))(_Expression(body).read()))
        elif word in until:
            return nodes, body
        elif word == "set" and "=" in rest:
            name, _, value = rest.partition("=")
            nodes.append(_set(name.strip(), _Expression(value).read()))
        elif word == "for" and " in " in rest:
            name, _, over = rest.partition(" in ")
            inner, _ = _parsed(pieces, ("endfor",))
            nodes.append(_loop(name.strip(), _Expression(over).read(), inner))
        elif word == "if":
            branches: list[tuple[Value | None, list[Node]]] = []
            condition: Value | None = _Expression(rest).read()
            while True:
                inner, end = _parsed(pieces, ("elif", "else", "endif"))
                branches.append((condition, inner))
                if end == "endif":
                    break
                condition = None if end == "else" else _Expression(end.removeprefix("elif")).read()
            nodes.append(_case(branches))
        else:
            raise ValueError(f"a template may not hold {body!r} here")
    if until:
        raise ValueError(f"a template lacks {until[-1]!r}")
    return nodes, ""


def compile_template(template: str, trim_blocks: bool = True) -> Callable[..., Column]:
    """A function from names to the text that the template gives: ``compiled(messages=F.col("messages"), bos_token="<s>")``.

    ``messages`` is an array of structs; other names may be columns, strings, numbers or truth values.
    """
    nodes, _ = _parsed(list(_pieces(template, trim_blocks)))

    def compiled(**names: Any) -> Column:
        return _joined(_run(nodes, dict(names)))

    return compiled
