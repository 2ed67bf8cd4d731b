"""String helpers that keep Python text semantics inside Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.strip() removes.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Word runs of Latin letters and digits are one token, every other visible character is its own.
# Both Java and RE2 read this pattern the same way.
TOKEN = "[0-9A-Za-z_À-ɏ]+|[^0-9A-Za-z_À-ɏ\\s 　]"


def py_strip(text: Column) -> Column:
    """``str.strip()`` with Unicode white space, U+3000 included; no regular expression involved."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return F.coalesce(py_strip(text), F.lit("")) == ""


def fold_newlines(text: Column) -> Column:
    """Universal newlines: text files are read with CRLF and CR as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def stripped_lines(text: Column) -> Column:
    """Non-blank lines of a text, each stripped."""
    return F.filter(F.transform(lines(text), py_strip), lambda line: line != "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def first_tokens_pattern(n: int) -> str:
    """The start of a text up to the end of its ``n``-th token."""
    return rf"^(?:[\s\x{{a0}}\x{{3000}}]*(?:{TOKEN})){{0,{n}}}"


def first_tokens(text: Column, n: int) -> Column:
    """``text`` up to the end of its ``n``-th token; the rest is not looked at."""
    return F.regexp_extract(text, first_tokens_pattern(n), 0)


def token_count(text: Column) -> Column:
    """Length of ``text`` under the built-in token rule."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def token_id(token: Column, vocab: int, reserved: int) -> Column:
    """Stable id in ``[reserved, vocab)``; hashing needs no shared vocabulary table."""
    head = F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")
    return (F.pmod(head, F.lit(vocab - reserved)) + F.lit(reserved)).cast("int")
