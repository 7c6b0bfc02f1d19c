"""DuckDB SQL of the operators that are defined without learning, written from their definitions alone."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: 20-word windows whose words also start earlier; every word such a window covers goes.
OP7 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, p FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM again),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

#: Shingle sets, links by counted intersections, and the smallest doc_id reachable.
OP10 = rf"""
WITH RECURSIVE d AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
    SELECT DISTINCT doc_id, CASE WHEN len(w) >= 4 THEN array_to_string(w[p:p + 3], ' ') ELSE array_to_string(w, ' ') END AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (
    SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT edge.b, reach.c FROM reach JOIN edge ON edge.a = reach.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)"""

#: Targets, Sainte-Lague seats by source and by shard, seeded blocks, and the words each document gets.
OP11 = r"""
WITH sized AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS h FROM documents),
goal AS (SELECT 1.5 * CAST(sum(size) AS DOUBLE) AS g FROM sized),
src AS (SELECT source, place, source_size, [3, 1, 2][1 + place % 3] AS weight
        FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
              FROM sized GROUP BY source)),
turn AS (SELECT *, row_number() OVER o AS t, coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_size,
                sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
         FROM src WINDOW o AS (ORDER BY 2.0 * source_size / weight, place)),
rate AS (SELECT arg_min((g - 2 * CAST(full_size AS DOUBLE)) / CAST(open_weight AS DOUBLE), t) AS r FROM turn, goal
         WHERE weight * ((g - 2 * CAST(full_size AS DOUBLE)) / CAST(open_weight AS DOUBLE)) <= 2 * source_size),
tgt AS MATERIALIZED (
    SELECT source, place, source_size, CASE WHEN weight * r > 2 * source_size THEN CAST(2 * source_size AS DOUBLE) ELSE weight * r END AS target
    FROM src, rate),
seat1 AS (SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place, k) AS n
          FROM (SELECT *, unnest(range(0, CAST(2 * ceil(source_size / 32.0) AS BIGINT))) AS k FROM tgt)),
won AS MATERIALIZED (
    SELECT tgt.source, source_size, target, count(n) AS seats, CAST(ceil(source_size / 32.0) AS BIGINT) AS blocks
    FROM tgt LEFT JOIN (SELECT seat1.source, n FROM seat1, goal WHERE n <= floor(g / 32 + 0.5)) s ON s.source IS NOT DISTINCT FROM tgt.source GROUP BY ALL),
shard AS (SELECT *, least(524288, source_size - i * 524288) AS words
          FROM (SELECT *, unnest(range(0, (greatest(blocks, 1) - 1) // 16384 + 1)) AS i FROM won)),
seat2 AS (SELECT source, i, row_number() OVER (PARTITION BY source ORDER BY CAST(words AS DOUBLE) / (2 * k + 1) DESC, i, k) AS n, seats
          FROM (SELECT *, unnest(range(0, CAST(2 * ceil(words / 32.0) AS BIGINT))) AS k FROM shard)),
quota AS (SELECT source, i, count(*) AS q FROM seat2 WHERE n <= seats GROUP BY ALL),
block AS (SELECT source, i, b, row_number() OVER (PARTITION BY source, i ORDER BY sha256('42:' || coalesce(source, '') || ':' || CAST(b AS VARCHAR))) AS n,
                 count(*) OVER (PARTITION BY source, i) AS of
          FROM (SELECT source, i, unnest(range(i * 16384, least((i + 1) * 16384, blocks))) AS b FROM shard)),
times AS (SELECT block.source, b, q // of + CAST(n <= q % of AS BIGINT) AS times
          FROM block JOIN quota ON quota.source IS NOT DISTINCT FROM block.source AND quota.i = block.i),
line AS MATERIALIZED (
    SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size, rid ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM sized),
got AS (SELECT rid, sum(times * (least(start + size, (t.b + 1) * 32) - greatest(start, t.b * 32))) AS taken
        FROM (SELECT *, unnest(range(start // 32, (start + size - 1) // 32 + 1)) AS b FROM line WHERE size > 0) l
        JOIN times t ON t.source IS NOT DISTINCT FROM l.source AND t.b = l.b GROUP BY rid)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM line JOIN tgt ON tgt.source IS NOT DISTINCT FROM line.source LEFT JOIN got USING (rid)"""

#: All rows against every anchor.
OP13 = """
WITH v AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, a.label = v.label AS alike, v.vec_id,
           CAST(list_sum(list_transform(list_zip(a.q, v.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER o AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM s JOIN p USING (anchor_id)
WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW o AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER o <= 5"""

SQL: dict[str, str] = {
    "op7_fixed_block_dedup": OP7,
    "op10_prefix_tree_join": OP10,
    "op11_source_mixing": OP11,
    "op13_multi_index_negatives": OP13,
}
