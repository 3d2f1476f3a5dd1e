"""SQL that gives the same rows as registered queries of this subpackage, where SQL can say it on whole tables."""

from __future__ import annotations

import string

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(2, len(w) - 2)), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT node, min(reached) AS component FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component AS component_id, c.component = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""

DECONTAMINATION = rf"""
WITH i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT item_id, least(len(w), 13) AS size, unnest(list_transform(range(1, greatest(2, len(w) - 11)), lambda k: array_to_string(list_slice(w, k, k + 12), ' '))) AS g FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
z AS (SELECT DISTINCT size FROM g),
o AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS k, unnest(list_transform(range(1, len(w) - size + 2), lambda k: array_to_string(list_slice(w, k, k + size - 1), ' '))) AS g FROM d JOIN z ON len(w) >= size),
m AS (SELECT DISTINCT o.doc_id, o.k, o.size, g.item_id FROM o JOIN g ON g.g = o.g AND g.size = o.size),
h AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS spot FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_UNITS = "regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]')"

FILL_IN_MIDDLE = rf"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, {_UNITS} AS u, sha256('1:' || CAST(doc_id AS VARCHAR)) AS x FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM u),
b AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM b)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

LINE_DEDUP = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS place FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS k FROM l),
g AS (SELECT k FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(g.k) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (g.k IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN g USING (k) GROUP BY doc_id
"""


def _vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Each round is a join of all parts with their codebook's entries; d(k) are the assignments to the entries of round k."""
    steps = [f"""
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, q, list_slice(x, q * len(x) // {parts} + 1, (q + 1) * len(x) // {parts}) AS x FROM v, range({parts}) t(q)),
c0 AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY e < {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
d{k} AS (SELECT vec_id, label, q, x, c.e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c.c[i]) * (x[i] - c.c[i]))) AS d FROM p JOIN c{k} c USING (q)
        QUALIFY row_number() OVER (PARTITION BY vec_id, q ORDER BY d, c.e) = 1)""")
        if k < rounds:
            steps.append(f"""
s{k} AS (SELECT q, e, i, CAST(floor_div(sum(x), count(*)) AS BIGINT) AS m FROM (SELECT q, e, unnest(x) AS x, unnest(range(1, len(x) + 1)) AS i FROM d{k}) GROUP BY q, e, i),
m{k} AS (SELECT q, e, list(m ORDER BY i) AS c FROM s{k} GROUP BY q, e),
c{k + 1} AS (SELECT c.q, c.e, coalesce(m.c, c.c) AS c FROM c{k} c LEFT JOIN m{k} m USING (q, e))""")
    last = rounds
    return f"""
WITH {",".join(steps)},
o AS (SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY q) AS code, CAST(sum(d) AS BIGINT) AS error FROM d{last} GROUP BY vec_id),
z AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY q, e, i)) AS h FROM (SELECT q, e, unnest(c) AS x, unnest(range(1, len(c) + 1)) AS i FROM c{last}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, z.h AS codebooks_sha256 FROM o, z
""".replace("floor_div(sum(x), count(*))", "((sum(x) - (((sum(x) % count(*)) + count(*)) % count(*))) // count(*))")


VECTOR_CODES = _vector_codes()
