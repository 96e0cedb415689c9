"""SQL twins of the queries on repeated strings, benchmark words, near duplicates and URLs."""

from tallyframe.llm.url_filter import SOFT_TERMS, STRICT_TERMS

REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce("text", ''))) AS h, CAST(octet_length(encode(coalesce("text", ''))) AS BIGINT) AS n FROM documents),
p AS (SELECT doc_id, i, md5(substring(h, CAST(2 * i + 1 AS BIGINT), 200)) AS k FROM d, unnest(range(0, n - 99)) AS t(i)),
f AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM p) WHERE nth > 1),
l AS (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM f),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM l),
r AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, run),
s AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c, a FROM r
  UNION ALL SELECT d.doc_id, coalesce(max(r.b), 0), max(d.n) FROM d LEFT JOIN r ON d.doc_id = r.doc_id GROUP BY d.doc_id),
k AS (SELECT s.doc_id, string_agg(substring(h, CAST(2 * c + 1 AS BIGINT), CAST(2 * (a - c) AS BIGINT)), '' ORDER BY c, a) AS kept FROM s JOIN d ON s.doc_id = d.doc_id GROUP BY s.doc_id),
c AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS gone, count(*) AS spans FROM r GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(c.gone, 0) AS n_removed, coalesce(c.spans, 0) AS n_spans, sha256(unhex(k.kept)) AS kept_sha256
FROM d JOIN k ON d.doc_id = k.doc_id LEFT JOIN c ON d.doc_id = c.doc_id
"""

_LOWER = """translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""

LEAKS_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, ns, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT doc_id, i, n, item FROM dw JOIN iw USING (n, win)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hit, unnest(range(i, i + n)) AS u(q) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

NEAR_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM m JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN k ON d.doc_id = k.a LEFT JOIN n ON n.doc_id = d.doc_id
"""


def _hits(terms: dict[str, int]) -> str:
    return " + ".join(f"CASE WHEN regexp_matches(u, '(^|[^a-z]){t}([^a-z]|$)') THEN {w} ELSE 0 END" for t, w in terms.items())


URLS_SQL = rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, translate(url_decode(coalesce(url, '')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u FROM pages),
h AS (SELECT *, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule,
  CAST({_hits(dict.fromkeys(STRICT_TERMS, 1))} AS BIGINT) AS strict_terms, CAST({_hits(dict.fromkeys(SOFT_TERMS, 1))} AS BIGINT) AS soft_terms,
  CAST({_hits(SOFT_TERMS)} AS BIGINT) AS soft_weight FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR strict_terms > 0 OR soft_weight >= 12 THEN 'block' ELSE 'allow' END AS verdict, strict_terms, soft_terms, soft_weight FROM r
"""
