"""DuckDB SQL for the queries that SQL can express, straight from their definitions."""

from __future__ import annotations

_COMPONENTS = """r(id, reach) AS (SELECT id, id FROM n UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)"""

OP1_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, md5('few ' || array_to_string(w, ' ')) FROM w WHERE len(w) BETWEEN 1 AND 4),
m AS (SELECT doc_id, count(*) AS m FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN m x ON x.doc_id = a JOIN m y ON y.doc_id = b WHERE 100 * k >= 80 * (x.m + y.m - k)),
n AS (SELECT DISTINCT doc_id AS id FROM documents), {_COMPONENTS}
SELECT d.doc_id, coalesce(m.m, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN m USING (doc_id) JOIN c ON c.id = d.doc_id
"""

OP5_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.label = y.label AND x.id <> y.id WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
n AS (SELECT vec_id AS id FROM embeddings), k AS (SELECT a AS id, count(*) AS n_links FROM l GROUP BY 1), {_COMPONENTS}
SELECT c.id AS vec_id, coalesce(k.n_links, 0) AS n_links, c.component_id, c.component_id = c.id AS kept FROM c LEFT JOIN k USING (id)
"""

OP6_SQL = """
SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""

OP7_SQL = """
WITH hosts AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages),
names AS (
  SELECT 'host' AS kind, host FROM hosts WHERE host <> ''
  UNION ALL SELECT DISTINCT 'domain', regexp_extract(host, '([^.]+[.][^.]+)$', 1) FROM hosts WHERE regexp_extract(host, '([^.]+[.][^.]+)$', 1) <> ''),
coded AS (
  SELECT kind, host, CAST(ascii(substr(md5(host), 1, 1)) AS BIGINT) * 7919 + ascii(substr(md5(host), 2, 1)) * 104729 + ascii(substr(md5(host), 3, 1)) * 1299709 AS k FROM names),
dated AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 'malware' WHEN 1 THEN 'spam' ELSE 'adult' END AS list,
         CASE kind WHEN 'host' THEN k % 180 ELSE k % 300 END AS day, CASE kind WHEN 'host' THEN 30 + k % 97 ELSE 1 + k % 11 END AS length FROM coded),
intervals AS (
  SELECT list, kind, host, TIMESTAMP '2024-01-01' + to_days(CAST(day AS INT)) AS valid_from, TIMESTAMP '2024-01-01' + to_days(CAST(day + length AS INT)) AS valid_to FROM dated
  UNION ALL SELECT list, kind, host, TIMESTAMP '2024-01-01' + to_days(CAST(day + 2 * length AS INT)), NULL FROM dated),
captures AS (
  SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, TIMESTAMP '2024-01-01' + to_minutes(CAST(page_id * 37 % 527040 AS INT)) AS fetched_at FROM pages),
met AS (
  SELECT c.page_id, count(*) AS n_active, string_agg(i.list || ':' || i.kind || ':' || i.host, ' ' ORDER BY i.list || ':' || i.kind || ':' || i.host) AS matched
  FROM captures c JOIN intervals i ON i.valid_from <= c.fetched_at AND (i.valid_to IS NULL OR c.fetched_at < i.valid_to)
   AND ((i.kind = 'host' AND i.host = c.host) OR (i.kind = 'domain' AND (c.host = i.host OR ends_with(c.host, '.' || i.host))))
  GROUP BY c.page_id)
SELECT c.page_id, c.url, c.fetched_at, coalesce(m.n_active, 0) AS n_active, coalesce(m.n_active, 0) > 0 AS blocked, coalesce(m.matched, '') AS matched
FROM captures c LEFT JOIN met m USING (page_id)
"""

OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, (2 * i + 1)::BIGINT, 100) AS s FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS gone FROM w),
z AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) > 50 AS new FROM f WHERE gone),
g AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM z),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY 1, 2),
x AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r),
k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) AS head FROM x JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE head || substr(h, (2 * last + 1)::BIGINT) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP9_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT doc_id, i FROM v QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
g AS (SELECT DISTINCT doc_id, i + k AS j FROM f CROSS JOIN (SELECT unnest(range(20)) AS k)),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
a AS (SELECT e.doc_id, count(*) AS n_words, count(g.j) AS n_removed, string_agg(CASE WHEN g.j IS NULL THEN word END, ' ' ORDER BY e.j) AS kept FROM e LEFT JOIN g ON g.doc_id = e.doc_id AND g.j = e.j GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""
