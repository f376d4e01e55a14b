"""SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from .quality import BOILERPLATE_WORDS, NAVIGATION, PHRASE, TERMINAL

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM both_ JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) m USING (doc_id)
"""

OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS w FROM d),
g AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM w)),
r AS (SELECT doc_id, count(DISTINCT k + j) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) v(j) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
m AS (SELECT doc_id, l, length(l) AS chars, len(regexp_extract_all(l, '{_WORD}')) AS n, len(regexp_extract_all(l, {_text(NAVIGATION)})) AS marks, len(regexp_extract_all(l, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(l, '!!+')) AS shouts FROM l),
f AS (SELECT *, (marks >= 3 AND marks * 5 >= n) OR symbols > CAST(0.1 AS DOUBLE) * chars OR shouts * 2 > n OR (NOT regexp_matches(l, {_text(TERMINAL)}) AND n < 8) OR (regexp_matches(l, {_text("(?i)" + PHRASE)}) AND (n <= {BOILERPLATE_WORDS} OR 2 * length(regexp_replace(l, {_text("(?i)" + PHRASE)}, '', 'g')) <= chars)) AS fails FROM m),
x AS (SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT l) FILTER (n > 0) AS n_dup_lines, coalesce(sum(chars) FILTER (NOT fails), 0) AS kept_chars, sum(chars) AS all_chars FROM f GROUP BY doc_id),
b AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, kept_chars, all_chars
  FROM w JOIN x USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND kept_chars >= 0.5 * all_chars AS kept FROM b
"""

_ODD = "'<|im_end|><|im_start|>assistant ok'"
OP9 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', {_ODD} UNION ALL SELECT -1, 1, 'assistant', {_ODD}),
e AS (SELECT *, CASE WHEN contains(text, '<|im_end|>') OR contains(text, '<|im_start|>') OR regexp_matches(text, '<\\+\|') THEN len(regexp_extract_all(text, '<\\*\|')) ELSE 0 END AS extra FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
  CAST(sum(length('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)) + extra) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

SQL = {"op2_ngram_jaccard_join": OP2, "op8_quality_rules": OP8, "op9_chat_formatting": OP9}
