"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import quality

_WORDS = r"[^\x20\x09-\x0D]+"


def quality_rules() -> str:
    """Words with positions, repeated windows by grouping, coverage by a running maximum of window starts."""
    sizes = [quality.REPEAT_WINDOW, *quality.GRAM_PERCENT]
    sizes = list(dict.fromkeys(sizes))
    ctes, marks = [], []
    for n in sizes:
        window = ", ".join(f"lead(w, {i}) OVER p" for i in range(n))
        ctes.append(f"""
g{n} AS (SELECT doc_id, i, w, chars, n, [{window}] AS g FROM toks WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
h{n} AS (SELECT doc_id, i, chars, i + {n} <= n + 1 AND count(*) OVER (PARTITION BY doc_id, g) > 1 AND i + {n} <= n + 1 AS hit FROM g{n}),
c{n} AS (SELECT doc_id, chars, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM h{n}),
s{n} AS (SELECT doc_id, count(*) FILTER (inside) AS words{n}, coalesce(sum(chars) FILTER (inside), 0) AS chars{n} FROM c{n} GROUP BY doc_id)""")
        marks.append(f"LEFT JOIN s{n} USING (doc_id)")
    bad = " OR ".join([
        f"100 * coalesce(line_chars, 0) > {quality.LINE_PERCENT} * coalesce(word_chars, 0)",
        f"100 * n_symbols > {quality.SYMBOL_PERCENT} * coalesce(word_chars, 0)",
        *[f"100 * coalesce(chars{n}, 0) > {p} * coalesce(word_chars, 0)" for n, p in quality.GRAM_PERCENT.items()],
    ])
    window = quality.REPEAT_WINDOW
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
toks AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w, length(unnest(ws)) AS chars, len(ws) AS n FROM docs),
sums AS (SELECT doc_id, sum(chars) AS word_chars FROM toks GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k, unnest(string_split(text, chr(10))) AS line FROM docs),
real AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS nth FROM lines WHERE len(regexp_extract_all(line, '{_WORDS}')) > 0),
dups AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(array_to_string(regexp_extract_all(line, '{_WORDS}'), ''))) AS line_chars FROM real WHERE nth > 1 GROUP BY doc_id),{",".join(ctes)},
joined AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(word_chars, 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(words{window}, 0) AS n_repeat_words, line_chars, {", ".join(f"chars{n}" for n in quality.GRAM_PERCENT)}
  FROM docs LEFT JOIN sums USING (doc_id) LEFT JOIN dups USING (doc_id) {" ".join(marks)})
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words OR {bad}) AS kept
FROM joined"""


def line_dedup_sql() -> str:
    """Distinct lines with their first places; pairs of like length that share half of a line, compared code point by code point."""
    return f"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM docs),
firsts AS (SELECT line, min((doc_id, pos)) AS first, length(line) AS n FROM lines WHERE regexp_matches(line, '{_WORDS}') GROUP BY line),
long AS (SELECT * FROM firsts WHERE n >= 20),
pairs AS (
  SELECT a.line AS a, b.line AS b, a.first AS fa, b.first AS fb, a.n AS n, b.n AS m FROM long a JOIN long b
  ON b.n = a.n AND a.line < b.line AND (left(a.line, (b.n - 1) // 2) = left(b.line, (b.n - 1) // 2) OR right(a.line, (b.n - 1) // 2) = right(b.line, (b.n - 1) // 2))
  UNION ALL
  SELECT a.line, b.line, a.first, b.first, a.n, b.n FROM long a JOIN long b
  ON b.n = a.n + 1 AND (left(a.line, (b.n - 1) // 2) = left(b.line, (b.n - 1) // 2) OR right(a.line, (b.n - 1) // 2) = right(b.line, (b.n - 1) // 2))),
near AS (
  SELECT CASE WHEN fa > fb THEN a ELSE b END AS line FROM pairs
  WHERE CASE WHEN n = m THEN len(list_filter(range(1, n + 1), lambda i: a[i] <> b[i])) = 1
    ELSE len(list_filter(range(0, n + 1), lambda i: left(a, i) = left(b, i) AND right(a, n - i) = right(b, n - i))) > 0 END),
judged AS (
  SELECT l.doc_id, l.pos, l.line, f.line IS NOT NULL AND ((l.doc_id, l.pos) <> f.first OR l.line IN (SELECT line FROM near)) AS gone
  FROM lines l LEFT JOIN firsts f ON l.line = f.line),
sums AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN sums USING (doc_id)"""


def substring_dedup_sql(window: int = 35) -> str:
    """Windows as word lists, counted; a word goes if one of the windows that cover it was counted twice or more."""
    return f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(ws) - {window - 2})) AS i FROM docs),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + {window - 1}], ' ')) AS h FROM starts JOIN docs USING (doc_id)),
many AS (SELECT doc_id, i, count(*) OVER (PARTITION BY h) > 1 AS hit FROM windows),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM docs),
judged AS (
  SELECT doc_id, i, w, bool_or(coalesce(hit, false)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS gone
  FROM words LEFT JOIN many USING (doc_id, i)),
sums AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM judged GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN sums USING (doc_id)"""


ORACLES = {"op2_substring_dedup": substring_dedup_sql(), "op5_quality_rules": quality_rules(), "op9_line_dedup": line_dedup_sql()}
