"""DuckDB SQL of the corpus queries that SQL can express, written from their definitions.

Queries whose rows hang on a trained model (op2, op3, op7, op8, op10) or on a
seeded hash that DuckDB lacks (op4) have none; their tests compare with brute
force or held-out rows.
"""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"

OP1 = """WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT doc_id, b, octet_length(b) AS n FROM b),
w AS (SELECT doc_id, s, md5(hex(b[s + 1 : s + 200])) AS h FROM (SELECT doc_id, b, unnest(range(0, n - 199)) AS s FROM n WHERE n >= 200)),
r AS (SELECT doc_id, s FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
f AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM f),
p AS (SELECT doc_id, g, min(s) AS lo, max(s) + 200 AS hi FROM g GROUP BY 1, 2),
k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM p),
j AS (SELECT n.doc_id, n.n, count(k.lo) AS spans, coalesce(sum(hi - lo), 0) AS removed, coalesce(string_agg(hex(b[before + 1 : lo]), '' ORDER BY lo), '') || hex(any_value(b[coalesce(last_hi, 0) + 1 : n])) AS rest FROM n LEFT JOIN k USING (doc_id) LEFT JOIN (SELECT doc_id, max(hi) AS last_hi FROM p GROUP BY 1) USING (doc_id) GROUP BY 1, 2)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM j"""

def _near(source: str) -> str:
    """Common tables of the near-duplicate classes among the rows of ``source`` (doc_id, text): m (doc_id, class_id), e (x, y: links both ways)."""
    return f"""nw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM {source}),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM nw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 5 * c >= 4 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM nw UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b),
m AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY 1)"""


OP5 = f"""WITH RECURSIVE {_near('documents')}
SELECT doc_id, class_id, CAST((SELECT count(*) FROM e WHERE e.x = m.doc_id) AS BIGINT) AS n_links FROM m"""

_NEEDED = "least(10, greatest(2, CASE WHEN any_value(fixed) = 0 THEN 10 ELSE ceil(30 / any_value(fixed)) END))"

OP6 = f"""WITH RECURSIVE d AS (SELECT doc_id, text, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
u AS (SELECT doc_id, unnest(ls) AS ln, unnest(range(len(ls))) AS i FROM d),
t AS (SELECT *, list_transform(regexp_extract_all(ln, {_WORDS}), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN chr(1) ELSE x END) AS w FROM u),
k AS (SELECT doc_id, i, len(w) AS n, j, w, CASE WHEN j = 0 THEN w ELSE list_transform(w, lambda x, p: CASE WHEN p > 3 AND (p - 4) * 4 // greatest(len(w) - 3, 1) = j - 1 THEN chr(2) ELSE x END) END AS m, list_sum(list_transform(range(3, len(w)), lambda p: CASE WHEN (p - 3) * 4 // greatest(len(w) - 3, 1) = j - 1 THEN 1 ELSE 0 END)) AS free FROM t, (SELECT unnest(range(5)) AS j) WHERE len(w) > 0),
q AS (SELECT doc_id, i, j || ':' || n || ':' || array_to_string(m, chr(31)) AS key, len(list_filter(m, lambda x: x <> chr(1) AND x <> chr(2))) AS fixed FROM k WHERE j = 0 OR (free > 0 AND n - free > 3)),
hot AS (SELECT key FROM q GROUP BY 1 HAVING count(DISTINCT doc_id) >= {_NEEDED}),
met AS (SELECT q.* FROM q JOIN hot USING (key)),
holders AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM met)),
{_near('holders')},
final AS (SELECT key FROM met JOIN m USING (doc_id) GROUP BY 1 HAVING count(DISTINCT class_id) >= {_NEEDED}),
gone AS (SELECT DISTINCT doc_id, i FROM met JOIN final USING (key)),
kept AS (SELECT u.doc_id, string_agg(ln, chr(10) ORDER BY u.i) AS text FROM u LEFT JOIN gone USING (doc_id, i) WHERE gone.i IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST((SELECT count(*) FROM gone WHERE gone.doc_id = d.doc_id) AS BIGINT) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9 = f"""WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents), b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
own AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, i, n, CAST(item_id AS VARCHAR) AS item_id FROM own JOIN win USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)"""
