"""DuckDB SQL for those queries of this subpackage that SQL can express in good time."""

_A, _B = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_B}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
"""

OP5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM s),
f AS (SELECT k, min(doc_id) AS least FROM k GROUP BY k),
g AS (SELECT doc_id, i FROM k JOIN f USING (k) WHERE least < doc_id),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
v AS (SELECT u.doc_id, u.word, u.i, max(g.i) OVER (PARTITION BY u.doc_id ORDER BY u.i) AS last FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.i = u.i),
z AS (SELECT doc_id, word, i, last IS NOT NULL AND i - last < 50 AS gone FROM v)
SELECT d.doc_id, len(d.w) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN z USING (doc_id) GROUP BY d.doc_id, len(d.w)
"""

OP8 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM k) WHERE nth > 1),
u AS (SELECT doc_id, unnest(range(0, length(h) // 2)) AS i FROM d),
v AS (SELECT u.doc_id, u.i, max(g.i) OVER (PARTITION BY u.doc_id ORDER BY u.i) AS last FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.i = u.i),
z AS (SELECT doc_id, i, coalesce(i - last < 100, false) AS gone FROM v),
r AS (SELECT doc_id, i, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM z),
s AS (SELECT r.doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(substr(h, 2 * i + 1, 2), '' ORDER BY i) FILTER (NOT gone) AS kept FROM r JOIN d USING (doc_id) GROUP BY r.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
"""

ORACLE_SQL = {"op3_ngram_jaccard_join": OP3, "op5_substring_dedup": OP5, "op8_suffix_array_dedup": OP8}
