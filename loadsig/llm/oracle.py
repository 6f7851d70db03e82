"""SQL texts for the training-data queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_REACH = """
reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a),
comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

ORACLE["op2_pivot_near_dedup"] = f"""WITH RECURSIVE
e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
nodes AS (SELECT vec_id AS id FROM e),
linked AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.vec_id <> y.vec_id
           WHERE list_cosine_similarity(x.v, y.v) >= 0.95E0),{_REACH},
n AS (SELECT a AS id, count(*) AS n FROM linked GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM comp LEFT JOIN n USING (id)"""

ORACLE["op3_threshold_top_k"] = """WITH
e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INT) AS "rank", vec_id, score FROM r WHERE n <= 10"""

ORACLE["op5_fair_queue_mix"] = r"""WITH
d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place FROM documents),
w AS (SELECT source, source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight,
             CAST(2 * source_size AS DOUBLE) AS cap
      FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
l AS (SELECT *, (sum(source_size) OVER () * 1.5E0 - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0E0))
              / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
             row_number() OVER o AS n
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
t AS (SELECT source, source_size, least(cap, (SELECT arg_min(level, n) FROM l WHERE cap / weight >= level) * weight) AS target FROM l),
q AS (SELECT source, place, sum(size) AS size FROM d GROUP BY source, place),
f AS (SELECT q.source, place, "round", size, CASE WHEN target > 0 THEN (ended + "round" * source_size) / target ELSE 0.0E0 END AS finish
      FROM (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY place) AS DOUBLE) AS ended FROM q) q
      JOIN t ON q.source IS NOT DISTINCT FROM t.source, (SELECT unnest([0, 1]) AS "round")),
k AS (SELECT source, "round", max(place) AS cut
      FROM (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, "round", place) AS total FROM f)
      WHERE total <= (SELECT floor(sum(source_size) * 1.5E0) FROM t) GROUP BY 1, 2)
SELECT doc_id, d.source, size, source_size, target, copies, size * copies AS taken
FROM (SELECT d.*, CAST((SELECT count(*) FROM k WHERE k.source IS NOT DISTINCT FROM d.source AND d.place <= k.cut) AS INT) AS copies FROM d) d
JOIN t ON d.source IS NOT DISTINCT FROM t.source"""

ORACLE["op8_perspective_chat"] = r"""WITH
t AS (SELECT DISTINCT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '<\|') AS role,
             replace(coalesce("text", ''), '<|', '<\|') AS "text" FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, "text") - 1 AS rn FROM t),
p AS (SELECT n.*, s.perspective, CAST(rn // 256 AS BIGINT) AS part,
             CASE WHEN role = 'system' THEN '<|system|>' WHEN role = s.perspective THEN '<|assistant|>'
                  ELSE '<|user name=' || role || '|>' END || chr(10) AS head
      FROM n JOIN (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system') s
      ON n.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (SELECT *, CAST(coalesce(sum(length(head) + length("text") + 8) OVER
                (PARTITION BY conv_id, perspective, part ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                + length(head) AS BIGINT) AS st FROM p)
SELECT conv_id, perspective, part, count(*) AS n_turns,
       sha256(string_agg(head || "text" || '<|end|>' || chr(10), '' ORDER BY rn)) AS text_sha256,
       coalesce(string_agg(CASE WHEN role = perspective THEN st || ':' || (st + length("text")) END, ',' ORDER BY rn), '') AS mask
FROM o GROUP BY conv_id, perspective, part"""

ORACLE["op9_minhash_near_dedup"] = rf"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1),
                                                                     lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
u AS (SELECT doc_id, unnest(sh) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
nodes AS (SELECT doc_id AS id FROM n),
linked AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),{_REACH}
SELECT n.doc_id, n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN comp ON comp.id = n.doc_id"""

ORACLE["op12_filter_audit"] = r"""WITH
w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce("text", '') AS t,
             regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT
             + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest([0, 1, 2, 3, 4]) AS f),
o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM f a, f b, f c, f d, f e
      WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT array_to_string(list_transform(o, lambda x: 'ABCDE'[x + 1]), '') AS filter_order, step, CAST(1 << o[step] AS INT) AS b,
             coalesce(CAST(list_sum(list_transform(o[1:step - 1], lambda x: 1 << x)) AS INT), 0) AS early
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, b, sum(CASE WHEN mask & (early | b) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & b > 0 AND mask & early = 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & b > 0 AND mask & early > 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = b THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & b > 0 AND mask & early = 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & b > 0 AND mask & early = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM d, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley
FROM r"""
