"""DuckDB SQL that says the same as a query: brute force over all windows or all pairs, for small tables."""

#: Every pair of texts that shares a shingle, exact probability Jaccard, transitive closure.
NEAR_DUPLICATES = r"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY 1),
w AS (SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
s AS (SELECT id, sh, count(*)::DOUBLE AS x FROM (SELECT id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w) GROUP BY ALL),
m AS (SELECT id, sum(x) AS m FROM s GROUP BY id),
o AS (SELECT a.id AS a, b.id AS b, sum(a.x) AS ma, sum(b.x) AS mb FROM s a JOIN s b ON a.sh = b.sh AND a.id < b.id GROUP BY ALL),
c AS (SELECT a, b FROM o JOIN m x ON x.id = a JOIN m y ON y.id = b WHERE ma >= 0.8 * x.m - 1e-9 AND mb >= 0.8 * y.m - 1e-9),
u AS (SELECT a, b, sh, max(xa) AS xa, max(xb) AS xb FROM (SELECT a, b, sh, x AS xa, 0 AS xb FROM c JOIN s ON s.id = a UNION ALL SELECT a, b, sh, 0, x FROM c JOIN s ON s.id = b) GROUP BY ALL),
j AS (SELECT d.a, d.b, d.sh, sum(greatest(e.xa / d.xa, e.xb / d.xb)) AS total FROM u d JOIN u e ON d.a = e.a AND d.b = e.b WHERE d.xa > 0 AND d.xb > 0 GROUP BY ALL),
l AS (SELECT a, b FROM j GROUP BY a, b HAVING sum(1 / total) >= 0.8 - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id, id AS other FROM t UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a),
k AS (SELECT id, min(other) AS class_id FROM r GROUP BY id)
SELECT d.doc_id, k.class_id, t.copies FROM documents d JOIN t ON t.text = coalesce(d.text, '') JOIN k ON k.id = t.id"""

#: Every window of 35 words, grouped by content.
REPEATED_WORDS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n, ws FROM d),
h AS (SELECT doc_id, i, word, CASE WHEN i + 34 <= n THEN md5(array_to_string(ws[i:i + 34], ' ')) END AS k FROM p),
c AS (SELECT k FROM h WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
f AS (SELECT h.*, max(CASE WHEN c.k IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM h LEFT JOIN c ON h.k = c.k),
r AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS begins FROM f),
g AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '')) AS kept_sha256, count(*) FILTER (begins) AS n_repeats FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256, coalesce(n_repeats, 0) AS n_repeats FROM documents LEFT JOIN g USING (doc_id)"""

#: Every string of 50 bytes (as hex, cut from pieces of 1,024 bytes) with the least doc_id that has it.
REPEATED_BYTES = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
q AS (SELECT doc_id, j, substr(x, 2048 * j + 1, 2048 + 98) AS x, length(x) // 2 - 1024 * j AS left_ FROM (SELECT doc_id, x, unnest(range(0, (length(x) + 2047) // 2048)) AS j FROM d)),
p AS (SELECT doc_id, 1024 * j + i AS i, substr(x, 2 * i + 1, 2) AS b, CASE WHEN left_ - i >= 50 THEN md5(substr(x, 2 * i + 1, 100)) END AS k FROM (SELECT *, unnest(range(0, least(1024, left_))) AS i FROM q)),
c AS (SELECT k, min(doc_id) AS m FROM p WHERE k IS NOT NULL GROUP BY k),
f AS (SELECT p.doc_id, i, b, max(CASE WHEN m < p.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM p LEFT JOIN c ON p.k = c.k),
r AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS begins FROM f),
g AS (SELECT doc_id, count(*) AS n_bytes, CAST(sum(gone) AS BIGINT) AS n_removed, count(*) FILTER (begins) AS n_spans, sha256(unhex(coalesce(string_agg(b, '' ORDER BY i) FILTER (gone = 0), ''))) AS kept_sha256 FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM documents LEFT JOIN g USING (doc_id)"""
