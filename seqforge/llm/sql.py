"""SQL, for DuckDB, of the queries that it can express: plain all-pairs and all-windows versions."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS uid, doc_id, {_WORDS} AS w FROM documents),
g AS (
  SELECT DISTINCT uid, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT uid, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT uid, count(*) AS n FROM g GROUP BY uid),
p AS (SELECT x.uid AS a, y.uid AS b, count(*) AS c FROM g AS x JOIN g AS y ON x.s = y.s AND x.uid <> y.uid GROUP BY x.uid, y.uid),
l AS (
  SELECT a, b, c = na.n AND c = nb.n AS same
  FROM p JOIN n AS na ON na.uid = a JOIN n AS nb ON nb.uid = b WHERE 5 * c >= 4 * (na.n + nb.n - c)),
r AS (SELECT uid, uid AS root FROM d UNION SELECT r.uid, l.b FROM r JOIN l ON r.root = l.a),
k AS (SELECT r.uid, min(e.doc_id) AS class_id FROM r JOIN d AS e ON e.uid = r.root GROUP BY r.uid),
q AS (SELECT a AS uid, count(*) AS n_links, min(e.doc_id) FILTER (same) AS twin FROM l JOIN d AS e ON e.uid = b GROUP BY a)
SELECT doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, least(doc_id, coalesce(twin, doc_id)) AS rep_id
FROM d JOIN k USING (uid) LEFT JOIN q USING (uid)
"""

OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_WORDS} AS w FROM documents),
v AS (
  SELECT uid, i, count(*) OVER (PARTITION BY win) AS n
  FROM (SELECT uid, i, array_to_string(w[i:i + 34], ' ') AS win
        FROM (SELECT uid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35))),
gone AS (SELECT DISTINCT uid, unnest(range(i, i + 35)) AS i FROM v WHERE n > 1),
x AS (SELECT uid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
k AS (
  SELECT x.uid, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (gone.i IS NULL) AS kept
  FROM x LEFT JOIN gone ON gone.uid = x.uid AND gone.i = x.i GROUP BY x.uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (uid)
"""
