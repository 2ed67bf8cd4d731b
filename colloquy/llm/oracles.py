"""DuckDB SQL for the operators that SQL can express, over the whole tables."""

from __future__ import annotations

from colloquy.llm import quality
from colloquy.llm.substring_dedup import WINDOW
from colloquy.llm.words import SPACES, WORD

_STOP_FORMS = ", ".join(f"'{form}'" for form in quality.STOP_FORMS)
_WITHIN = " AND ".join(f"{rule.measure} BETWEEN {rule.least} AND {rule.most}" for rule in quality.RULES)

OP6 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), parts AS (
  SELECT k, doc_id, t, regexp_extract_all(t, '{WORD}') AS w,
    [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^{SPACES}]')] AS l
  FROM d
), tokens AS (
  SELECT k, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM parts
), windows AS (
  SELECT k, i, a, lead(a) OVER own AS b, lead(a, 2) OVER own AS c FROM tokens WINDOW own AS (PARTITION BY k ORDER BY i)
), twice AS (
  SELECT k, i, a, c IS NOT NULL AND count(*) OVER (PARTITION BY k, a, b, c) > 1 AS r FROM windows
), covered AS (
  SELECT k, a, r OR coalesce(lag(r) OVER own, false) OR coalesce(lag(r, 2) OVER own, false) AS r
  FROM twice WINDOW own AS (PARTITION BY k ORDER BY i)
), words AS (
  SELECT k, count(*) AS n_words, sum(length(a))::BIGINT AS word_chars, count(*) FILTER (r) AS n_repeat_words,
    count(*) FILTER (a IN ({_STOP_FORMS})) AS n_stop
  FROM covered GROUP BY k
), counts AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    length(t) - length(regexp_replace(t, '[{quality.SYMBOLS}]', '', 'g')) AS n_symbols,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_stop, 0) AS n_stop, len([x FOR x IN l IF rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…']) AS n_ellipsis
  FROM parts LEFT JOIN words USING (k)
), ratios AS (
  SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED_PERCENT} * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
    CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
    CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_word_share,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
    CASE WHEN n_lines > 0 THEN n_ellipsis / n_lines ELSE 0 END AS ellipsis_line_share
  FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_WITHIN} AS kept
FROM ratios
"""

OP9 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), starts AS (
  SELECT k, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}
), windows AS (
  SELECT k, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM starts
), twice AS (
  SELECT s FROM windows GROUP BY s HAVING count(*) > 1
), covered AS (
  SELECT DISTINCT k, i + j AS i FROM (SELECT k, i, unnest(range({WINDOW})) AS j FROM windows JOIN twice USING (s))
), tokens AS (
  SELECT k, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d
), kept AS (
  SELECT k, count(*) AS n, string_agg(a, ' ' ORDER BY i) AS t FROM tokens ANTI JOIN covered USING (k, i) GROUP BY k
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
"""

ORACLE_SQL = {"op6_quality_rules": OP6, "op9_substring_dedup": OP9}
