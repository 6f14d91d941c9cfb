"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS k FROM w, unnest(range(1, len(w) - 6)) AS u(i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM dup, unnest(range(i, i + 8)) AS u(p) GROUP BY doc_id),
lin AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
m AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_text_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words,
  len(list_filter(w, lambda x: regexp_matches(x, '\p{Lu}[^\p{Ll}]*\p{Lu}') AND NOT regexp_matches(x, '\p{Ll}'))) AS n_shouted,
  len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_run_words
  FROM w JOIN lin USING (doc_id) LEFT JOIN rep USING (doc_id)),
r AS (SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_text_lines THEN 8 ELSE 0 END
  + CASE WHEN 100 * n_shouted > 50 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words THEN 64 ELSE 0 END + CASE WHEN 100 * n_run_words > 30 * n_words THEN 128 ELSE 0 END AS fail_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, fail_bits = 0 AS kept, CAST(fail_bits AS BIGINT) AS fail_bits FROM r
"""

# The two versions of the policy, as masks: the base has rules 0 and 1, the other all eight.
ABLATIONS = f"""
WITH b AS (SELECT fail_bits AS f FROM ({OP1})),
p AS (SELECT version, m, rule, CAST(1 AS BIGINT) << k AS bit FROM (VALUES ('base', 3), ('2024-1', 255)) AS v(version, m),
  (VALUES (0, 'few_words'), (1, 'repeated_windows'), (2, 'symbols'), (3, 'duplicate_lines'), (4, 'shouting'), (5, 'long_words'), (6, 'short_words'), (7, 'word_runs')) AS r(k, rule))
SELECT version, rule, count(*) AS n_docs, count(*) FILTER (WHERE f & bit > 0) AS n_failed, count(*) FILTER (WHERE f & m > 0) AS n_rejected,
  count(*) FILTER (WHERE f & m = bit) AS n_only, count(*) FILTER (WHERE f & m = 0 AND f & bit > 0) AS n_added FROM b, p GROUP BY version, rule
"""

_LINE_KEY = "translate(trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = f"""
WITH l AS (SELECT doc_id, u.i AS pos, s[u.i] AS line, {_LINE_KEY.format(x="s[u.i]")} AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i)),
f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT l.*, f.k IS NOT NULL AS gone FROM l LEFT JOIN f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 1), ' ') AS g FROM w, unnest(range(1, greatest(len(w), 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS nb FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * nb >= 80 * (x.n + y.n - nb)),
v AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT v.b, r.c FROM r JOIN v ON r.doc_id = v.a WHERE r.c < v.b),
c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP12 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256(concat('42:', CAST(doc_id AS VARCHAR))) AS h FROM documents),
g AS (SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n, list_transform(range(0, 4), lambda i: CAST(concat('0x', substr(h, CAST(1 + 8 * i AS INT), 8)) AS BIGINT)) AS h FROM t),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid) ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""

ORACLES = {"op12_fill_middle": OP12, "op1_quality_rules": OP1, "op5_line_dedup": OP5, "op6_near_dedup": OP6, "quality_ablations": ABLATIONS}
