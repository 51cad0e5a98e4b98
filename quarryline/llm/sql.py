"""DuckDB SQL with the same rows as the queries of this folder, over whole tables."""

_PAIRS = """
WITH ids AS (SELECT id, min(content) AS content FROM retrieve WHERE id IS NOT NULL AND content IS NOT NULL GROUP BY id),
words AS (SELECT id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+') AS w FROM ids),
sh AS (SELECT DISTINCT id, concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS s
       FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
pairs AS (SELECT id_a, id_b FROM shared JOIN n na ON na.id = id_a JOIN n nb ON nb.id = id_b WHERE k / (na.n + nb.n - k) >= 0.70)
"""

_SPANS = """
WITH recs AS (SELECT DISTINCT 'retrieve' AS rec_table, id AS rec_key, content AS x FROM retrieve WHERE id IS NOT NULL AND content IS NOT NULL
              UNION ALL SELECT DISTINCT 'cross_references', CAST(edge_id AS VARCHAR), context FROM cross_references WHERE edge_id IS NOT NULL AND context IS NOT NULL),
win AS (SELECT rec_table, rec_key, i, md5(substr(x, i, 160)) AS h FROM (SELECT *, unnest(range(1, length(x) - 158)) AS i FROM recs WHERE length(x) >= 160)),
same AS (SELECT h FROM win GROUP BY h HAVING count(DISTINCT rec_table || ':' || rec_key) > 1),
hit AS (SELECT DISTINCT rec_table, rec_key, i FROM win SEMI JOIN same USING (h))
"""

_LEXIMIN = """
WITH s AS (SELECT query_id, id, mode, max(CASE WHEN mode IN ('bm25', 'dense') THEN search_score WHEN mode = 'hybrid+rerank' THEN rerank_score END) AS score
           FROM retrieve WHERE query_id IS NOT NULL AND id IS NOT NULL GROUP BY ALL),
c AS (SELECT DISTINCT query_id, id FROM s),
g AS (SELECT c.query_id, c.id, m.mode, s.score FROM c CROSS JOIN (VALUES ('bm25'), ('dense'), ('hybrid+rerank')) AS m(mode)
      LEFT JOIN s ON s.query_id = c.query_id AND s.id = c.id AND s.mode = m.mode),
p AS (SELECT query_id, id, mode, (rank() OVER (PARTITION BY query_id, mode ORDER BY score NULLS FIRST) - 1) / greatest(1, count(*) OVER (PARTITION BY query_id, mode) - 1) AS p FROM g),
v AS (SELECT query_id, id, list_sort(list(p)) AS v FROM p GROUP BY ALL),
r AS (SELECT query_id, id, v[1] AS p1, v[2] AS p2, v[3] AS p3, row_number() OVER (PARTITION BY query_id ORDER BY v[1] DESC, v[2] DESC, v[3] DESC, id) AS rank_no FROM v)
"""

SQL = {
    "p1_found": _LEXIMIN + "SELECT query_id, id FROM r WHERE rank_no = 1",
    "p1_ranking": _LEXIMIN + "SELECT query_id, id, p1, p2, p3, rank_no FROM r",
    "p2_found": "SELECT DISTINCT id FROM retrieve WHERE length(content) > 2048",
    "p3_found": _SPANS + "SELECT DISTINCT rec_table, rec_key FROM hit",
    "p3_shared": _SPANS
    + """SELECT rec_table, rec_key, n_chars, coalesce(shared, 0) AS shared_chars
FROM (SELECT rec_table, rec_key, max(length(x)) AS n_chars FROM recs GROUP BY ALL)
LEFT JOIN (SELECT rec_table, rec_key, CAST(sum(least(160, gap)) AS BIGINT) AS shared
           FROM (SELECT rec_table, rec_key, coalesce(i - lag(i) OVER (PARTITION BY rec_table, rec_key ORDER BY i), 160) AS gap FROM hit)
           GROUP BY ALL) USING (rec_table, rec_key)""",
    "p5_found": _PAIRS + "SELECT id_a, id_b FROM pairs",
    "p5_groups": _PAIRS.replace("WITH ids", "WITH RECURSIVE ids")
    + """, edges AS (SELECT id_a AS a, id_b AS b FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
reach AS (SELECT id, id AS root FROM ids UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.id)
SELECT id, min(root) AS group_id, coalesce((SELECT count(*) FROM edges e WHERE e.a = reach.id), 0) AS links FROM reach GROUP BY id""",
}
