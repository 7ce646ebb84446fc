"""SQL counterparts of the queries that SQL can express, for an engine with list functions.

They compare texts, words and n-grams themselves, where the operators compare hashes.
"""

from __future__ import annotations

_EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of no bytes

WARC_REVISITS = """
WITH h AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
     d AS (SELECT page_id, url, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM h),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d),
     r AS (SELECT *, payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS revisit FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN first_id END AS refers_to, url, '<urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || ':sha256:' || payload_digest || '>' AS record_id
FROM r"""

#: Only A-Z fold: translate leaves all other letters alone.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"'[^\x20\x09-\x0D]+'"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_TERM = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"

FRAGMENT_JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACE}) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS g FROM w),
-- Texts of equal sets are one class.
k AS (SELECT doc_id, len(g) AS n, CASE WHEN len(g) > 0 THEN array_to_string(list_sort(g), chr(10)) END AS key, g FROM s),
c AS (SELECT key, min(doc_id) AS id, any_value(n) AS n, any_value(g) AS g FROM k WHERE key IS NOT NULL GROUP BY key),
x AS (SELECT id, n, unnest(g) AS g FROM c),
p AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 75 * (na + nb - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, reached) AS (SELECT id, id FROM c WHERE id IN (SELECT a FROM e) UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reached),
m AS (SELECT id, min(reached) AS component FROM r GROUP BY id)
SELECT k.doc_id, k.n AS n_shingles, coalesce(m.component, c.id, k.doc_id) AS component_id
FROM k LEFT JOIN c ON c.key = k.key LEFT JOIN m ON m.id = c.id"""


DOUBLED_WINDOWS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACE}) AS w FROM documents),
v0 AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS first_id FROM v0 GROUP BY k),
g AS (SELECT v0.doc_id, v0.i FROM v0 JOIN f ON f.k = v0.k AND f.first_id < v0.doc_id),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
y AS (SELECT x.doc_id, x.i, x.word, max(g.i) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
      FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i),
z AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM y GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, '{_EMPTY}') AS kept_sha256
FROM d LEFT JOIN z ON z.doc_id = d.doc_id"""

WU_MANBER = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS m FROM (SELECT item_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM benchmark) WHERE len(w) > 0),
t AS (SELECT DISTINCT item_id, m, list_slice(w, i, i + m - 1) AS k FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
x AS (SELECT doc_id, i, m, list_slice(w, i, i + m - 1) AS k FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM t) WHERE len(w) >= m)),
h AS (SELECT x.doc_id, x.i, x.m, t.item_id FROM x JOIN t ON t.m = x.m AND t.k = x.k),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM h) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, '{_EMPTY}') AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN o ON o.doc_id = d.doc_id"""

SOURCE_DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, {_TERM}) AS w FROM documents),
u AS (SELECT i, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM u GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM u JOIN kept USING (lang, term) GROUP BY ALL),
full_c AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM full_c JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n) AS n FROM full_c GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM l JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(p.p - q.q AS BIGINT) AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50"""
