"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

#: White space that is stripped from the ends of a line.
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

ORACLE = {
    "op1_line_dedup": f"""
        WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
        lines AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS pos FROM parts),
        keyed AS (SELECT *, translate(trim(line, {_SPACE}), {_UPPER}, {_LOWER}) AS k FROM lines),
        refs AS (SELECT k, max(doc_id) AS max_doc FROM keyed WHERE length(k) >= 20
                 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
        marked AS (SELECT doc_id, line, pos, coalesce(doc_id < max_doc, false) AS gone FROM keyed LEFT JOIN refs USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op3_pivot_topk": """
        WITH v AS (SELECT vec_id, [floor(x::DOUBLE * 256) for x in embedding] AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
              FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_gnat_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS lab,
                          [floor(x::DOUBLE * 256) for x in embedding] AS e FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.lab = v.lab AS same, list_inner_product(a.e, v.e)::BIGINT AS score
              FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                     row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
                   AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op9_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\\x20\\x09-\\x0D]+') AS a FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 4 THEN [array_to_string(a, ' ')]
                  ELSE [array_to_string(a[i:i + 3], ' ') for i in range(1, len(a) - 2)] END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS same FROM s GROUP BY doc_id),
        pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
        links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
        sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, x.b FROM reach r JOIN sides x ON x.a = r.other),
        least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(min(n.doc_id) OVER (PARTITION BY n.same), w.doc_id) AS class_id, component_id
        FROM w JOIN least USING (doc_id) LEFT JOIN n ON n.doc_id = w.doc_id""",
}
