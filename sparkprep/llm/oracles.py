"""SQL equivalents, for DuckDB, of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"[x FOR x IN regexp_split_to_array({}, '[\x20\x09-\x0D]+') IF x <> '']"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS shingle
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, least(len(ws), 1)))) AS i FROM w)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
),
reach AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT b, root FROM reach JOIN links ON a = reach.doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, w.doc_id = r.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""

OP3 = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
  FROM documents
),
runs AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS c
  FROM (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS run
        FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w))
),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM runs, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
c AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(list_sum([length(x) FOR x IN ws]), 0)::BIGINT AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
         length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) + strlen(t) - length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) AS n_letters,
         length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks,
         len([x FOR x IN ws IF NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')]) AS n_bare
  FROM w LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR word_chars < 3 * n_words
            OR word_chars > 10 * n_words OR 10 * n_dup_lines > 4 * n_lines OR 10 * n_upper > 3 * n_letters
            OR 10 * n_bare > 3 * n_words OR 10 * n_marks > 3 * n_words) AS kept
FROM c
"""

OP7 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
runs AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS copy
  FROM (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS run
        FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM w))
),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS i FROM runs WHERE copy > 1),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

ORACLE = {"op2_minhash_near_dedup": OP2, "op3_quality_rules": OP3, "op7_substring_dedup": OP7}
