"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

#: Words of a text, one list per document.
_SPACED = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
#: The same in lower case, A-Z only.
_LOW = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH docs AS (
  SELECT doc_id, {_SPACED.format(text="coalesce(text, '')")} AS w FROM documents),
windows AS (
  SELECT doc_id, s, sha256(array_to_string(w[s:s + 19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM docs WHERE len(w) >= 20)),
again AS (
  SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
removed AS (
  SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM again) GROUP BY doc_id),
words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
lost AS (
  SELECT doc_id, unnest(gone) AS p FROM removed),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN lost USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM docs d LEFT JOIN kept USING (doc_id)
"""

OP5 = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
urls AS (
  SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(verdict, rule, rule_host, rule_path) AS (
  VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN fits USING (page_id)
"""

OP8 = """
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
hexes AS (SELECT doc_id, lower(hex(b)) AS x, octet_length(b) AS n FROM docs),
starts AS (
  SELECT doc_id, s, md5_number(substr(x, 2 * s - 1, 400)) AS h
  FROM (SELECT doc_id, x, unnest(range(1, n - 198)) AS s FROM hexes WHERE n >= 200)),
hits AS (SELECT doc_id, s FROM starts QUALIFY count(*) OVER (PARTITION BY h) > 1),
marked AS (SELECT doc_id, s, max(s + 200) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hits),
islands AS (SELECT doc_id, s, sum((reach IS NULL OR s > reach)::INT) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM marked),
spans AS (SELECT doc_id, k, min(s) AS a, max(s) + 200 AS z FROM islands GROUP BY doc_id, k),
gaps AS (SELECT doc_id, k, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY k), 1) AS open FROM spans),
kept AS (
  SELECT g.doc_id, count(*) AS n_spans, sum(z - a) AS n_removed,
         string_agg(substr(x, 2 * open - 1, 2 * (a - open)), '' ORDER BY k) || substr(any_value(x), 2 * max(z) - 1) AS rest
  FROM gaps g JOIN hexes USING (doc_id) GROUP BY g.doc_id)
SELECT h.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, x))) AS kept_sha256
FROM hexes h LEFT JOIN kept USING (doc_id)
"""

OP9 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({dlow}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array({dlow}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') AS k
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, s, p.size, item FROM places p JOIN windows v ON p.k = v.k AND p.size = v.size),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY doc_id),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS q FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN hit USING (doc_id)
""".replace("{dlow}", _LOW.format(text="coalesce(text, '')"))

OP10 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_SPACED.format(text=_LOW.format(text="coalesce(text, '')"))} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) ELSE w END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)),
pairs AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT y, seen FROM reach JOIN pairs ON reach.doc_id = pairs.x WHERE seen < y),
least AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN n USING (doc_id)
"""

OP12 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_SPACED.format(text=_LOW.format(text="coalesce(text, '')"))} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * c >= 85 * (p.n + q.n - c)),
pairs AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT y, seen FROM reach JOIN pairs ON reach.doc_id = pairs.x WHERE seen < y),
least AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM least LEFT JOIN n USING (doc_id)
"""

OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, c.e), c.vec_id)::INT AS rank, c.vec_id, list_distance(q.e, c.e) AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
QUALIFY rank <= 10
"""

#: crc32 in SQL: a table of a byte's remainders, then a step per byte.
_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_CRC = "xor(list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"

OP11 = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS t),
runs AS (
  SELECT doc_id, run, length(run) AS size, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all({_LOW.format(text="text")}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (
  SELECT run, size, k, {_CRC.format(bytes="list_concat(list_transform(string_split(doc_id::VARCHAR || ':', ''), lambda c: ord(c)::BIGINT), flatten(list_transform(string_split(run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195, ord(c)::BIGINT - 64] END)))")} AS h FROM runs, crc),
words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, h % size) || substr(run, h % size + 2) ELSE run END AS word, k FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
places AS (SELECT word, length(word) AS size, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word AS w, b.word AS v FROM places a JOIN places b USING (size, i, rest) WHERE a.word <> b.word
  UNION SELECT p.word, s.word FROM places p JOIN words s ON p.rest = s.word
  UNION SELECT s.word, p.word FROM places p JOIN words s ON p.rest = s.word),
near AS (
  SELECT w, count(*) AS n_near, arg_min(v, (-n, v)) AS best, max(n) AS best_n FROM pairs JOIN words ON word = v GROUP BY w),
facts AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM words LEFT JOIN near ON w = word),
chain(word, last, step) AS (
  SELECT word, word, 0 FROM facts
  UNION ALL
  SELECT c.word, f.form, step + 1 FROM chain c JOIN facts f ON f.word = c.last WHERE f.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(last, step) FROM chain c WHERE c.word = facts.word) AS root, n, n_near::BIGINT AS n_near, form_n FROM facts
"""

OP13 = f"""
WITH crc AS (SELECT {_CRC_TABLE} AS t),
own AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS seq
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT c, seq, {_CRC.format(bytes="list_transform(string_split(c::VARCHAR, ''), lambda d: ord(d)::BIGINT)")} % 6 AS h FROM own, crc),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.seq, [])[1:a.h], a.seq[a.h + 1:]) AS seq FROM heads a LEFT JOIN own b ON b.c = a.c - a.c % 100),
members AS (SELECT c, len(seq) AS size, unnest(range(0, len(seq) + 1)) AS d, seq FROM rebuilt),
nodes AS (
  SELECT seq[1:d] AS node, d, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = size), '')) AS ends
  FROM members GROUP BY 1, 2),
children AS (SELECT node[1:d - 1] AS parent, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1, 2),
below AS (
  SELECT node[1:up] AS top, up, count(*) FILTER (k IS NULL) AS leaves, sum(CASE WHEN d > 0 THEN (n - 1) * length(node[d].x) ELSE 0 END) AS saved
  FROM (SELECT node, n, nodes.d AS d, k, unnest(range(0, nodes.d + 1)) AS up FROM nodes LEFT JOIN children ON parent = node AND children.d = nodes.d) GROUP BY 1, 2)
SELECT v.conv_id, v.d::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n::BIGINT AS n_convs, coalesce(k, 0)::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, v.ends AS ends_sha256
FROM nodes v JOIN below ON top = v.node AND up = v.d LEFT JOIN children ON parent = v.node AND children.d = v.d
LEFT JOIN nodes p ON v.d > 0 AND p.d = v.d - 1 AND p.node = v.node[1:v.d - 1]
"""
