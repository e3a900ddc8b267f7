"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH u AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), h AS (
  SELECT row_number() OVER () AS row_id, page_id,
         translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path
  FROM u
), r(verdict, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), m AS (
  SELECT h.*, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY row_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
  FROM h LEFT JOIN r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents
), w AS (
  SELECT r, doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT r, doc_id, x, unnest(range(length(x) // 2 - 49)) AS i FROM d WHERE length(x) >= 100)
), f AS (
  SELECT s, min(doc_id) AS first_id FROM w GROUP BY s HAVING count(*) > 1
), c AS (
  SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM w JOIN f USING (s) WHERE w.doc_id > f.first_id
), k AS (
  SELECT r, i, coalesce(i - before > 50, true) AS opens FROM c
), g AS (
  SELECT r, i, sum(opens::INT) OVER (PARTITION BY r ORDER BY i) AS span FROM k
), t AS (
  SELECT r, span, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY r, span
), u AS (
  SELECT t.r, a, z, coalesce(lag(z) OVER (PARTITION BY t.r ORDER BY a), 0) AS kept_from, x FROM t JOIN d ON t.r = d.r
), e AS (
  SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed,
         string_agg(substr(x, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS kept
  FROM u GROUP BY r
)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN e ON d.r = e.r
"""

OP12 = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab
), d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w0,
         xor(list_reduce(string_split(doc_id::VARCHAR, ''), lambda c, ch: xor(tab[(xor(c, ascii(ch)::BIGINT) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM documents, crc
), p AS (
  SELECT *, len(w0) AS n, h // 10 AS g, CASE WHEN len(w0) > 0 THEN (h // 10) % len(w0) END AS a FROM d
), q AS (
  SELECT r, doc_id, n, w0, h, a, 1 + (n - a) // (3 + g % 8) AS p FROM p
), t AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w0[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w0 END AS w FROM q
), x AS (
  SELECT r, n, unnest(range(n)) AS i, unnest(w) AS w FROM t
), m AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM x JOIN x AS y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), s AS (
  SELECT r, q, min(i) AS s, count(*) + q AS len FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS stretch FROM m) GROUP BY r, q, stretch
  HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s AS o WHERE o.r = s.r AND o.q < s.q AND o.s <= s.s AND o.s + o.len >= s.s + s.len)
), b AS (
  SELECT r, count(*) AS n_runs, arg_min({'s': s, 'len': len, 'q': q}, [-len, s, q]) AS top, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY r
), k AS (
  SELECT r, string_agg(w, ' ' ORDER BY i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.r = x.r AND x.i >= runs.s + runs.q AND x.i < runs.s + runs.len) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS start, top.len::BIGINT AS length, top.q::BIGINT AS period,
       (1000 * top.len // top.q)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN b ON t.r = b.r LEFT JOIN k ON t.r = k.r
"""

OP13 = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v AS a JOIN v AS c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 100 * score >= 30 * positive_score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2, "op11_suffix_dedup": OP11, "op12_periodic_runs": OP12, "op13_hard_negatives": OP13}
