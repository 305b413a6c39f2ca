"""SQL for DuckDB that says by brute force what the queries of this subpackage return."""

EXACT_DEDUP = """
    SELECT doc_id,
           max(doc_id) OVER same AS keep_id,
           count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

#: Every 100-byte string of every document is compared with all others.
SUFFIX_DEDUP = """
    WITH bytes AS (
        SELECT doc_id, encode(coalesce(text, '')) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
    ), parts AS (
        SELECT doc_id, base, h[base + 1:base + 1123] AS part, least(n - 99 - base, 1024) AS strings
        FROM (SELECT doc_id, h, n, unnest(range(0, n - 99, 1024)) AS base FROM bytes WHERE n >= 100)
    ), strings AS (
        SELECT doc_id, base + k AS start, part[k + 1:k + 100] AS string
        FROM (SELECT doc_id, base, part, unnest(range(strings)) AS k FROM parts)
    ), firsts AS (
        SELECT string, min((doc_id, start)) AS earliest FROM strings GROUP BY string HAVING count(*) > 1
    ), again AS (
        SELECT s.doc_id, s.start FROM strings s JOIN firsts f ON s.string = f.string WHERE (s.doc_id, s.start) > f.earliest
    ), marked AS (
        SELECT doc_id, start, CASE WHEN start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) <= 100 THEN 0 ELSE 1 END AS opens FROM again
    ), numbered AS (
        SELECT doc_id, start, sum(opens) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM marked
    ), runs AS (
        SELECT doc_id, run, min(start) AS open, max(start) + 100 AS past FROM numbered GROUP BY doc_id, run
    ), gaps AS (
        SELECT doc_id, open, lag(past, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS since FROM runs
    ), heads AS (
        SELECT g.doc_id, string_agg(hex(b.h[g.since + 1:g.open]), '' ORDER BY g.open) AS head FROM gaps g JOIN bytes b ON b.doc_id = g.doc_id
        WHERE g.open > g.since GROUP BY g.doc_id
    ), sums AS (
        SELECT doc_id, sum(past - open) AS removed, count(*) AS spans, max(past) AS past FROM runs GROUP BY doc_id
    )
    SELECT b.doc_id, CAST(b.n AS BIGINT) AS n_bytes, CAST(coalesce(s.removed, 0) AS BIGINT) AS n_removed, coalesce(s.spans, 0) AS n_spans,
           sha256(unhex(coalesce(h.head, '') || hex(b.h[coalesce(s.past, 0) + 1:b.n]))) AS kept_sha256
    FROM bytes b LEFT JOIN sums s ON b.doc_id = s.doc_id LEFT JOIN heads h ON b.doc_id = h.doc_id
"""

#: Intersections are counted for all pairs of documents that share a shingle.
NGRAM_JACCARD = r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), placed AS (
        SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words
    ), shingles AS (
        SELECT DISTINCT doc_id, shingle
        FROM (
            SELECT doc_id, n, i, concat_ws(' ', word, lead(word, 1) OVER d, lead(word, 2) OVER d, lead(word, 3) OVER d) AS shingle
            FROM placed WINDOW d AS (PARTITION BY doc_id ORDER BY i)
        ) WHERE i <= greatest(n - 3, 1)
    ), sets AS (
        SELECT d.doc_id, count(s.shingle) AS size FROM documents d LEFT JOIN shingles s ON s.doc_id = d.doc_id GROUP BY d.doc_id
    ), shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
        FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
        GROUP BY a.doc_id, b.doc_id
    ), links AS (
        SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
        WHERE 100 * n >= 85 * (x.size + y.size - n)
    ), steps AS (
        SELECT a, b FROM links UNION ALL SELECT b, a FROM links
    ), reach AS (
        SELECT doc_id, doc_id AS other FROM sets
        UNION
        SELECT r.doc_id, s.b FROM reach r JOIN steps s ON s.a = r.other
    )
    SELECT s.doc_id, s.size AS n_shingles, r.component_id
    FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = s.doc_id
"""

#: All products, exactly. The query searches a graph: on tables as small as those of sf0.001 and sf0.01 (500 vectors) its
#: search comes to every vector and the rows are the same, beyond that its recall counts.
NEAREST_NEIGHBOURS = """
    WITH vectors AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), products AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score
        FROM vectors q JOIN vectors c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
    ), ranked AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM products
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
