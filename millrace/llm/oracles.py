"""DuckDB SQL for the queries that SQL can express; tests/llm holds the others against brute force."""

from __future__ import annotations

import string

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM words
), keyed AS MATERIALIZED (
    SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS k, s FROM sets
), nodes AS MATERIALIZED (
    SELECT k, min(doc_id) AS node, any_value(n) AS n, any_value(s) AS s FROM keyed WHERE n > 0 GROUP BY k
), elements AS MATERIALIZED (
    SELECT node, n, unnest(s) AS t FROM nodes
), links AS MATERIALIZED (
    SELECT a.node AS u, b.node AS v FROM elements a JOIN elements b ON a.t = b.t AND a.node <> b.node
    GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
    SELECT node, node AS seen FROM nodes UNION SELECT r.node, l.v FROM reach r JOIN links l ON r.seen = l.u
), least AS (
    SELECT node, min(seen) AS component FROM reach GROUP BY node
)
SELECT d.doc_id, d.n AS n_shingles, coalesce(l.component, d.doc_id) AS component_id, d.doc_id = coalesce(l.component, d.doc_id) AS kept
FROM keyed d LEFT JOIN nodes m ON d.n > 0 AND d.k = m.k LEFT JOIN least l ON l.node = m.node
"""

CONTAMINATION = rf"""
WITH items AS (
    SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS MATERIALIZED (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
), docs AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), grams AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS MATERIALIZED (
    SELECT g.doc_id, g.i, g.n, x.item_id FROM grams g JOIN windows x ON g.n = x.n AND g.win = x.win
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), found AS (
    SELECT doc_id, count(item) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items, coalesce(f.digest, sha256('')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id
"""

ARCHIVES = """
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages
), tops AS (
    SELECT page_id, body, n, max(page_id) OVER (PARTITION BY body) AS top FROM payloads
)
SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM tops
"""

EXACT_DUPLICATES = r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM texts
"""

_NEAREST = """
a{k} AS MATERIALIZED (
    SELECT r, p, arg_min(e, d * 64 + e) AS e, min(d) AS d
    FROM (SELECT r, parts.p, e, list_sum([(v[j] - c[j]) * (v[j] - c[j]) for j in range(1, len(v) + 1)])::BIGINT AS d FROM parts JOIN b{k} ON b{k}.p = parts.p) GROUP BY r, p
)"""
_MOVED = """
b{n} AS MATERIALIZED (
    SELECT b{k}.p, b{k}.e, coalesce(m.c, b{k}.c) AS c
    FROM b{k} LEFT JOIN (
        SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c
        FROM (SELECT p, e, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM (SELECT a{k}.p, a{k}.e, v, unnest(range(1, len(v) + 1)) AS j FROM a{k} JOIN parts ON parts.r = a{k}.r AND parts.p = a{k}.p) GROUP BY p, e, j) GROUP BY p, e
    ) m ON m.p = b{k}.p AND m.e = b{k}.e
)"""
VECTOR_CODES = f"""
WITH kept AS (
    SELECT vec_id, label, [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) for c in embedding] AS x, row_number() OVER (ORDER BY vec_id) AS r
    FROM embeddings WHERE embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0
), parts AS MATERIALIZED (
    SELECT r, p, x[p * len(x) // 16 + 1:(p + 1) * len(x) // 16] AS v FROM (SELECT r, x, unnest(range(16)) AS p FROM kept)
), b0 AS MATERIALIZED (
    SELECT p, r - 1 AS e, v AS c FROM parts WHERE r <= 64
), {_NEAREST.format(k=0)}, {_MOVED.format(k=0, n=1)}, {_NEAREST.format(k=1)}, {_MOVED.format(k=1, n=2)}, {_NEAREST.format(k=2)},
coded AS (
    SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r
), book AS (
    SELECT sha256(string_agg(CAST(c[j] AS VARCHAR), ',' ORDER BY p, e, j)) AS digest FROM (SELECT p, e, c, unnest(range(1, len(c) + 1)) AS j FROM b2)
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256 FROM kept JOIN coded ON coded.r = kept.r, book
"""

ORACLE_SQL = {
    "op1_hyperminhash_dedup": NEAR_DUPLICATES,
    "op3_prefix_filtered_decontamination": CONTAMINATION,
    "op10_zstd_warc": ARCHIVES,
    "op11_block_naming_dedup": EXACT_DUPLICATES,
    "op13_filtering_lloyd_codes": VECTOR_CODES,
}
