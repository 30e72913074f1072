"""DuckDB SQL for the queries of this folder that SQL can express."""
from __future__ import annotations

# words split at ASCII white space; A-Z lower-cased without touching other letters
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

_SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM d WHERE len(ws) >= 13),
e AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS gram FROM s),
m AS (SELECT gram, min(doc_id) AS first_id FROM e GROUP BY gram),
c AS (SELECT DISTINCT e.doc_id, unnest(range(e.i, e.i + 13)) AS pos FROM e JOIN m USING (gram) WHERE m.first_id < e.doc_id),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d WHERE len(ws) > 0),
k AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.pos) AS kept FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.pos = c.pos GROUP BY p.doc_id),
n AS (SELECT doc_id, count(*) AS removed FROM c GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n.removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""

_DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS ws FROM documents),
b AS (SELECT item_id, ws, least(len(ws), 10) AS n FROM (SELECT item_id, {_PLAIN} AS ws FROM benchmark) WHERE len(ws) > 0),
bi AS (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM b),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM bi),
l AS (SELECT DISTINCT n FROM b),
di AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, l WHERE len(ws) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM di),
h AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.gram = bw.gram),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

_REVISITS = r"""
WITH u AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(trim(url), '#.*$', '', 's') AS url FROM pages),
v AS (SELECT page_id, html, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
             regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM u),
w AS (SELECT page_id, html, scheme, lower(regexp_extract(rest, '^[^/?]*')) AS host, regexp_replace(rest, '^[^/?]*', '') AS tail FROM v),
x AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(host, CASE scheme WHEN 'https' THEN ':443$' ELSE ':80$' END, ''), '^[^@]*@', ''), '^www\.', '') AS host,
             split_part(tail, '?', 1) AS path,
             array_to_string(list_sort(list_filter(string_split(regexp_extract(tail, '\?(.*)$', 1, 's'), '&'), lambda a: a <> '')), '&') AS asked FROM w),
c AS (SELECT page_id AS n, html, host || CASE path WHEN '' THEN '/' ELSE path END || CASE asked WHEN '' THEN '' ELSE '?' || asked END AS url,
             1700000000 + page_id * 60 AS base FROM x),
r AS (SELECT 2 * n AS id, url, base AS pos, n, html FROM c),
v2 AS (SELECT 2 * n + 1 AS id, url, base + CASE WHEN n % 7 = 0 THEN -60 ELSE 3700 END AS pos, n, html FROM c),
j AS (SELECT v2.id, v2.url, v2.n, v2.html, r.id AS rid, r.n AS rn, r.html AS rhtml,
             row_number() OVER (PARTITION BY v2.id ORDER BY r.pos DESC NULLS LAST, r.id DESC) AS k
      FROM v2 LEFT JOIN r ON v2.url = r.url AND (r.pos < v2.pos OR (r.pos = v2.pos AND r.id < v2.id))),
o AS (SELECT *, CASE WHEN rid IS NULL THEN 'unresolved'
                     WHEN n % 3 = 0 THEN CASE WHEN n % 28 = rn % 28 THEN 'resolved' ELSE 'mismatch' END
                     WHEN n % 5 <> 0 AND md5(html) = md5(rhtml) THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j WHERE k = 1)
SELECT id AS record_id, url, outcome, rid AS response_id, CASE outcome WHEN 'resolved' THEN sha1(rhtml) END AS payload_digest,
  CASE WHEN outcome = 'resolved' THEN
    CASE WHEN n % 3 = 0 THEN 'age: ' || (n % 100) || chr(10) ELSE '' END || 'content-length: ' || length(rhtml) || chr(10) || 'content-type: text/html' || chr(10)
    || 'etag: "' || md5(rhtml) || '"' || chr(10) || 'last-modified: day ' || CASE WHEN n % 3 = 0 THEN n % 28 ELSE rn % 28 END || chr(10) || 'x-cache: hit'
  WHEN n % 3 = 0 THEN 'age: ' || (n % 100) || chr(10) || 'last-modified: day ' || (n % 28) || chr(10) || 'x-cache: hit'
  ELSE 'content-length: 0' || chr(10) || 'etag: ' || CASE WHEN n % 5 = 0 THEN '"other"' ELSE 'W/"' || md5(html) || '"' END || chr(10) || 'x-cache: hit' END AS headers
FROM o"""

_RUNS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_SEARCH = f"""
WITH d AS (SELECT doc_id, {_RUNS} AS ws FROM documents),
s AS (SELECT count(*) AS docs, sum(len(ws)) AS words FROM d WHERE len(ws) > 0),
q AS (SELECT DISTINCT item_id, unnest({_RUNS}) AS term FROM benchmark),
p AS (SELECT doc_id, len(ws)::BIGINT AS n, unnest(ws) AS term FROM d),
t AS (SELECT doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, docs),
x AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // words)))))::BIGINT AS score
      FROM q JOIN t USING (term) JOIN w USING (term), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""

_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id,
       positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5"""

ORACLE = {"op1_substrings": _SUBSTRINGS, "op5_decontamination": _DECONTAMINATION, "op8_revisits": _REVISITS,
          "op12_lexical_search": _SEARCH, "op13_hard_negatives": _NEGATIVES}
