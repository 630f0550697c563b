"""DuckDB SQL for the operators that SQL can express, over whole tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_REACH = """
reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
components AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
"""

OP2 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
nodes AS (
  SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) END AS s FROM words),
items AS (SELECT id, unnest(s) AS x FROM nodes),
shared AS (SELECT p.id AS a, q.id AS b, count(*) AS k FROM items p JOIN items q ON p.x = q.x AND p.id <> q.id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN nodes m ON m.id = a JOIN nodes n ON n.id = b WHERE 100 * k >= 75 * (len(m.s) + len(n.s) - k)),
{_REACH}
SELECT id AS doc_id, len(s)::BIGINT AS n_shingles, component_id FROM nodes JOIN components USING (id)
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS x
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS k FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM docs, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, k, p.n, item FROM places p JOIN windows v ON v.n = p.n AND v.x = array_to_string(w[k:k + p.n - 1], ' ')),
counted AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN counted USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP7 = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
links AS (SELECT p.id AS a, q.id AS b FROM nodes p JOIN nodes q ON p.id <> q.id AND list_cosine_similarity(p.v, q.v) >= 0.95),
{_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id)::BIGINT AS n_links, component_id, id = component_id AS kept FROM components
"""

#: Bytes as two hexadecimal digits; a window's occurrences are counted by its md5.
OP3 = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 399)) AS p FROM docs WHERE len(h) >= 800),
hashed AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 800)) AS x FROM places JOIN docs USING (doc_id)),
repeated AS (SELECT x FROM hashed GROUP BY x HAVING count(*) > 1),
hits AS (SELECT doc_id, p FROM hashed JOIN repeated USING (x)),
starts AS (SELECT doc_id, p, coalesce(p > lag(p) OVER w + 400, TRUE) AS fresh FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
runs AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM starts),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 400 AS z FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, z, coalesce(lag(z) OVER w, 0) AS before FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
kept AS (
  SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS tail, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""
