"""DuckDB SQL for the queries that SQL can express on whole tables, written from their contracts."""

MIXING = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('17:' || doc_id), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[place % 3 + 1]::DOUBLE AS weight, 1.5 * sum(source_size) OVER () AS total FROM s),
rounds AS (
  SELECT 0 AS round, place, weight, 2.0 * source_size AS cap, total AS room, false AS full_up, total / sum(weight) OVER () AS level FROM w
  UNION ALL
  SELECT round + 1, place, weight, cap, room, now, (room - sum(CASE WHEN now THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN now THEN 0 ELSE weight END) OVER ()
  FROM (SELECT *, level * weight > cap AS now, bool_or(level * weight > cap AND NOT full_up) OVER () AS more FROM rounds) WHERE more),
t AS (
  SELECT w.*, least(cap, level * r.weight)::DOUBLE AS target FROM w JOIN rounds r USING (place) WHERE round = (SELECT max(round) FROM rounds)),
c AS (
  SELECT *, sum(target) OVER (ORDER BY place) / sum(target) OVER () AS hi FROM t),
stretch AS (
  SELECT *, coalesce(lag(hi) OVER (ORDER BY place), 0) AS lo, place = max(place) OVER () AS is_last FROM c),
b AS (SELECT greatest(1, least(4096, floor(sum(target) / 65536)))::BIGINT AS block, sum(target) AS total FROM t),
points AS (
  SELECT j, list_sum(list_transform(range(48), lambda i: ((j >> i) & 1) * power(2.0, -(i + 1)))) AS u
  FROM (SELECT unnest(range(ceil(total / block)::BIGINT)) AS j FROM b)),
n AS (
  SELECT place, count(u) AS slots FROM stretch LEFT JOIN points ON u >= lo AND (u < hi OR is_last) GROUP BY place),
laid AS (
  SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS a FROM d),
runs AS (
  SELECT t.*, block * least(slots, ceil(source_size / block)) AS one,
         block * least(greatest(slots - ceil(source_size / block), 0), ceil(source_size / block)) AS two
  FROM t JOIN n USING (place), b)
SELECT doc_id, size, source_size, target,
       (greatest(least(a + size, one) - a, 0) + greatest(least(a + size, two) - a, 0))::BIGINT AS taken
FROM laid JOIN runs ON laid.source IS NOT DISTINCT FROM runs.source
"""

SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, p, list_slice(w, p, p + 12) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
least_doc AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, p FROM win JOIN least_doc USING (k) WHERE doc_id > m),
gone AS (
  SELECT doc_id, list(q) AS g FROM (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

RANGE_JOIN = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM low
"""

HARD_NEGATIVES = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""
