"""DuckDB SQL for the operators of this subpackage that SQL can express."""

from __future__ import annotations

from . import quality_rules as rules
from .near_dup import SIMILARITY, WORDS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _covered(k: int, first_too: bool) -> str:
    """Per document: words, and characters, inside k-word windows that occur again."""
    again = "count(*) OVER (PARTITION BY doc_id, gram)" if first_too else "row_number() OVER (PARTITION BY doc_id, gram ORDER BY i)"
    return f"""
  SELECT doc_id, count(*) FILTER (WHERE hit) AS words, coalesce(sum(size) FILTER (WHERE hit), 0) AS chars FROM (
    SELECT doc_id, size, coalesce(max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW), 0) > 1 AS hit FROM (
      SELECT doc_id, i, size, CASE WHEN gram IS NOT NULL THEN {again} END AS again FROM (
        SELECT doc_id, i, length(ws[i]) AS size, CASE WHEN i + {k - 1} <= len(ws) THEN array_to_string(ws[i:i + {k - 1}], ' ') END AS gram
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w))))
  GROUP BY doc_id"""


def quality_rules_sql() -> str:
    """All measures by window functions over words and lines; ids must be distinct."""
    ctes = [f"w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents)", f"c{rules.WINDOW}r AS ({_covered(rules.WINDOW, True)})"]
    ctes += [f"c{k} AS ({_covered(k, False)})" for k in rules.COVERAGE]
    bare = r"regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')"
    ctes.append(f"""l AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length({bare})) AS dup_line_chars FROM (
      SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY p) AS n FROM (
        SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS p FROM w) WHERE {bare} <> '')
      WHERE n > 1 GROUP BY doc_id)""")
    joins = " ".join(f"LEFT JOIN {c} USING (doc_id)" for c in [f"c{rules.WINDOW}r", "l", *(f"c{k}" for k in rules.COVERAGE)])
    grams = ", ".join(f"coalesce(c{k}.chars, 0)" for k in rules.COVERAGE)
    ctes.append(f"""m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(c{rules.WINDOW}r.words, 0) AS BIGINT) AS n_repeat_words,
      CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars, [{grams}] AS grams FROM w {joins})""")
    # coverage is not measured where a text has no more words than the shortest n-gram
    limits = " AND ".join(f"(n_words <= {min(rules.COVERAGE)} OR grams[{n}] <= CAST({most} AS DOUBLE) * greatest(1, word_chars))" for n, most in enumerate(rules.COVERAGE.values(), 1))
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars,
  CAST(CASE WHEN n_words <= {min(rules.COVERAGE)} THEN 0 ELSE list_max(grams) END AS BIGINT) AS dup_gram_chars,
  n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words) AND {limits}
    AND dup_line_chars <= CAST({rules.LINE_COVERAGE} AS DOUBLE) * greatest(1, word_chars) AND n_symbols <= CAST({rules.SYMBOLS_PER_WORD} AS DOUBLE) * n_words AS kept
FROM m"""


#: Components of all pairs that share a window and overlap enough; ids must be distinct.
NEAR_DUPLICATES_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
g AS (SELECT doc_id, gram, count(*) AS c FROM (
  SELECT doc_id, array_to_string(ws[i:i + least({WORDS}, len(ws)) - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least({WORDS}, len(ws)) + 2)) AS i FROM w WHERE len(ws) > 0)) GROUP BY doc_id, gram),
n AS (SELECT doc_id, sum(c) AS n FROM g GROUP BY doc_id),
s AS (SELECT a.doc_id AS u, b.doc_id AS v, sum(least(a.c, b.c)) AS s FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM s JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE CAST(s AS DOUBLE) / (a.n + b.n - s) >= CAST({SIMILARITY} AS DOUBLE)),
both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, b.v FROM r JOIN both_ways b ON b.u = r.root)
SELECT id AS doc_id, min(root) AS class_id FROM r GROUP BY id
"""
