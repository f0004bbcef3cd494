WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g1 AS (SELECT lang, w1, count(*) AS f FROM (SELECT lang, unnest(ws) AS w1 FROM w) GROUP BY ALL),
g2 AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, count(*) AS f FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM w WHERE len(ws) >= 2) GROUP BY ALL),
g3 AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3, count(*) AS f FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3) GROUP BY ALL HAVING count(*) >= 10),
c2 AS (SELECT g2.lang, g2.w1 || ' ' || g2.w2 AS phrase, g2.f AS a, x.f AS l, y.f AS r
       FROM g2 JOIN g1 x ON x.lang = g2.lang AND x.w1 = g2.w1 JOIN g1 y ON y.lang = g2.lang AND y.w1 = g2.w2
       WHERE g2.f >= 10 AND NOT EXISTS (SELECT 1 FROM g3 WHERE g3.lang = g2.lang AND 100 * g3.f >= 50 * g2.f AND ((g3.w1 = g2.w1 AND g3.w2 = g2.w2) OR (g3.w2 = g2.w1 AND g3.w3 = g2.w2)))),
c3 AS (SELECT g3.lang, g3.w1 || ' ' || g3.w2 || ' ' || g3.w3 AS phrase, g3.f AS a, x.f AS l1, p23.f AS r1, p12.f AS l2, z.f AS r2
       FROM g3 JOIN g1 x ON x.lang = g3.lang AND x.w1 = g3.w1 JOIN g1 z ON z.lang = g3.lang AND z.w1 = g3.w3
       JOIN g2 p12 ON p12.lang = g3.lang AND p12.w1 = g3.w1 AND p12.w2 = g3.w2 JOIN g2 p23 ON p23.lang = g3.lang AND p23.w1 = g3.w2 AND p23.w2 = g3.w3),
s3 AS (SELECT lang, phrase, a, l1, r1, l2, r2, (1000000 * a::HUGEINT * a::HUGEINT) // (l1::HUGEINT * r1::HUGEINT) AS s1, (1000000 * a::HUGEINT * a::HUGEINT) // (l2::HUGEINT * r2::HUGEINT) AS s2 FROM c3),
cand AS (SELECT lang, phrase, a, l, r, (1000000 * a::HUGEINT * a::HUGEINT) // (l::HUGEINT * r::HUGEINT) AS score FROM c2
         UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM s3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rk FROM cand)
SELECT ranked.lang, rk::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, totals.n AS n, score::BIGINT AS score
FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rk <= 2000
