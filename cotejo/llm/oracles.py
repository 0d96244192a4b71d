"""DuckDB twins of operators 3, 9 and 10, by plain definition: no anchors, no signatures."""

from __future__ import annotations

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D ]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50),
win AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS t FROM k),
f AS (SELECT t, min(doc_id) AS m FROM win GROUP BY t),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM win JOIN f USING (t) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p WHERE gone.p IS NULL GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

NEAR_DEDUP = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

SUFFIX_DEDUP = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS k FROM d WHERE length(h) >= 100),
win AS (SELECT doc_id, k, md5_number(substring(h, 2 * k + 1, 100)) AS t FROM k),
f AS (SELECT t, min(doc_id) AS m FROM win GROUP BY t),
hit AS (SELECT doc_id, k FROM win JOIN f USING (t) WHERE m < doc_id),
i AS (SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 THEN 0 ELSE 1 END AS fresh FROM hit)),
run AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS b FROM i GROUP BY doc_id, g),
n AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans, max(b) AS tail FROM run GROUP BY doc_id),
piece AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM run),
kept AS (SELECT piece.doc_id, string_agg(substring(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS t FROM piece JOIN d USING (doc_id) GROUP BY piece.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN n.doc_id IS NULL THEN h ELSE t || substring(h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
