"""DuckDB SQL for the queries that SQL can express, over the pre-registered views."""

ORACLES: dict[str, str] = {}

ORACLES["op2_hyperminhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) = 1 THEN words
    ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles
  FROM w
), cls AS (
  SELECT min(doc_id) AS c, list_sort(shingles) AS k, any_value(len(shingles)) AS n FROM s WHERE len(shingles) > 0 GROUP BY list_sort(shingles)
), e AS (
  SELECT c, n, unnest(k) AS g FROM cls
), common AS (
  SELECT x.c AS a, y.c AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS i
  FROM e x JOIN e y ON x.g = y.g AND x.c < y.c AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY x.c, y.c
), links AS (
  SELECT a, b FROM common WHERE 100 * i >= 80 * (na + nb - i)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT c AS x, c AS y FROM cls UNION SELECT r.x, t.b FROM reach r JOIN both_ways t ON r.y = t.a
), root AS (
  SELECT x, min(y) AS r FROM reach GROUP BY x
), named AS (
  SELECT k, r FROM cls JOIN root ON c = x
)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, coalesce(named.r, s.doc_id) AS component_id, coalesce(named.r, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN named ON list_sort(s.shingles) = named.k
"""

ORACLES["op4_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0)::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), ranked AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s
), capped AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS k,
         coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from,
         1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM ranked WHERE source_size > 0
), level AS (
  SELECT min(k) AS k FROM capped WHERE (total - full_before) * w / w_from <= cap
), target AS (
  SELECT c.source, c.source_size,
         CASE WHEN l.k IS NULL OR c.k < l.k THEN c.cap ELSE (m.total - m.full_before) * c.w / m.w_from END AS target
  FROM capped c CROSS JOIN level l LEFT JOIN capped m ON m.k = l.k
  UNION ALL SELECT source, source_size, 0.0 FROM ranked WHERE source_size = 0
), need AS (
  SELECT *, CASE WHEN source_size > 0 THEN round_even(target, 0)::BIGINT // source_size ELSE 0 END AS full_reads,
            CASE WHEN source_size > 0 THEN round_even(target, 0)::BIGINT % source_size ELSE 0 END AS more
  FROM target
), placed AS (
  SELECT doc_id, d.source, size, source_size, target, full_reads, more,
         sum(size) OVER (PARTITION BY d.source ORDER BY md5('7:' || coalesce(doc_id::VARCHAR, 'null'))) AS upto,
         sum(size) OVER (PARTITION BY d.source, md5('7:' || coalesce(doc_id::VARCHAR, 'null'))) AS tied
  FROM d JOIN need n ON d.source IS NOT DISTINCT FROM n.source
)
SELECT doc_id, size, source_size, target,
       (size * (full_reads + CASE WHEN more > 0 AND 2 * upto - tied <= 2 * more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""

ORACLES["op10_warc"] = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""

ORACLES["op6_mtree"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def _k_means_sql(k: int = 40, rounds: int = 5, width: int = 64) -> str:
    """Assignment and replacement written out once for each round."""
    distance = "(list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x))"
    text = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {width} AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x
  FROM (SELECT sha256('2:' || vec_id::VARCHAR) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {k})
)"""
    for i in range(rounds + 1):
        text += f""", a{i} AS MATERIALIZED (
  SELECT v.r, min(struct_pack(d := {distance}::BIGINT, c := c.c)) AS b FROM v CROSS JOIN c{i} c GROUP BY v.r
)"""
        if i < rounds:
            text += f""", m{i} AS (
  SELECT c, p, sum(y::BIGINT) AS s, count(*) AS n
  FROM (SELECT a.b.c AS c, unnest(v.x) AS y, unnest(range({width})) AS p FROM v JOIN a{i} a ON v.r = a.r) GROUP BY c, p
), c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(n.x, c.x) AS x FROM c{i} c
  LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY p) AS x FROM m{i} GROUP BY c) n ON c.c = n.c
)"""
    return (
        text
        + f"""
SELECT v.vec_id, a.b.c::INT AS cluster, a.b.d AS distance, sum(a.b.d) OVER (PARTITION BY a.b.c)::BIGINT AS cluster_inertia, sum(a.b.d) OVER ()::BIGINT AS inertia,
       sha256(list_aggregate(list_transform(c.x, lambda y: y::BIGINT::VARCHAR), 'string_agg', ',')) AS centroid_sha256
FROM v JOIN a{rounds} a ON v.r = a.r JOIN c{rounds} c ON c.c = a.b.c
"""
    )


ORACLES["op11_centroids"] = _k_means_sql()
