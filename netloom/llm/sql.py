"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP9 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), linked AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
), edges AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked
), reach AS (
  SELECT x AS doc_id, least(x, y) AS least_id FROM edges
  UNION SELECT b.x, r.least_id FROM reach r JOIN edges b ON b.y = r.doc_id WHERE r.least_id < b.x
), components AS (SELECT doc_id, min(least_id) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(component_id, d.doc_id), d.doc_id) AS component_id,
  coalesce(least(component_id, d.doc_id), d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN components USING (doc_id)
"""


_HOST = r"""regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '^(www|m)\.', '')"""
_REST = r"""regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '#.*$', '')"""

OP1 = rf"""
WITH parts AS (
  SELECT page_id, md5(html) AS digest, {_HOST} AS host, {_REST} AS rest FROM pages
), named AS (
  SELECT page_id, digest, host, regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '(/index\.html?|/)$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) AS kept
  FROM parts
), pages_ AS (
  SELECT page_id, digest, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical,
    CASE WHEN page_id % 3 <> 0 THEN '"' || substr(digest, 1, 16) || '"' END AS etag FROM named
), paired AS (
  SELECT r.page_id + 1099511627776 AS record_id, r.canonical, r.page_id * 10 + 5000 AS moment, b.page_id AS b_id, b.etag AS b_etag, b.digest AS b_digest,
    CASE WHEN r.etag IS NOT NULL THEN CASE WHEN r.page_id % 5 = 0 THEN '"new"' ELSE r.etag END END AS etag,
    CASE WHEN r.page_id % 5 = 0 THEN 'new' ELSE r.digest END AS digest,
    row_number() OVER (PARTITION BY r.page_id ORDER BY b.page_id DESC) AS k
  FROM pages_ r JOIN pages_ b ON r.canonical = b.canonical AND b.page_id * 10 <= r.page_id * 10 + 5000
), judged AS (
  SELECT *, CASE WHEN etag IS NOT NULL AND b_etag IS NOT NULL THEN etag = b_etag ELSE digest = b_digest END AS fits FROM paired WHERE k = 1
)
SELECT record_id, canonical, CASE WHEN fits THEN b_id END AS base_id, CASE WHEN fits THEN 'resolved' ELSE 'mismatch' END AS outcome,
  CASE WHEN fits THEN b_digest END AS digest, CAST(moment AS VARCHAR) AS date, '0' AS expires,
  CASE WHEN fits THEN 'text/html' END AS content_type, CASE WHEN NOT fits THEN '0' END AS content_length
FROM judged
"""

OP3 = rf"""
WITH captures AS (SELECT page_id AS capture_id, page_id * 10 AS moment, {_HOST} AS host FROM pages
), hosts AS (SELECT DISTINCT host AS domain, CAST('0x' || substr(md5(host), 1, 7) AS BIGINT) AS h FROM captures WHERE host <> ''
), entries AS (SELECT ['adult', 'gambling', 'malware'][h % 3 + 1] AS list, domain, h % 100000 AS valid_from, h % 100000 + h % 40000 AS valid_to FROM hosts WHERE h % 7 < 3
), labels AS (SELECT capture_id, moment, string_split(host, '.') AS l FROM captures
), above AS (SELECT capture_id, moment, array_to_string(l[i:], '.') AS domain FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM labels)
), hits AS (
  SELECT capture_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains
  FROM above JOIN entries USING (domain) WHERE valid_from < valid_to AND valid_from <= moment AND moment < valid_to GROUP BY capture_id
)
SELECT capture_id, host, lists IS NOT NULL AS blocked, coalesce(lists, '') AS lists, coalesce(domains, '') AS domains FROM captures LEFT JOIN hits USING (capture_id)
"""

_KINDS = [
    ("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""),
    ("access", r"AKIA[A-Z0-9]{16,}"),
    ("hex", r"[0-9a-f]{24,}"),
    ("ident", r"""(?i)(?:access_?key_?id|access_?key|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{4,}"""),
    ("opaque", r"[A-Za-z0-9+/]{32,}={0,2}"),
    ("endpoint", r"""https?://[A-Za-z0-9.-]+(?::[0-9]+)?[^\x20\x09-\x0D"'<>]*"""),
]


def _op8() -> str:
    quoted = lambda p: p.replace("'", "''")
    pieces = " UNION ALL ".join(f"SELECT doc_id, {k} AS kind, string_split(regexp_replace(t, '({quoted(p)})', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)) AS p FROM docs" for k, (_, p) in enumerate(_KINDS))
    value = r"""(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    return rf"""
WITH docs AS (SELECT doc_id, replace(coalesce(text, ''), chr(57344), chr(65533)) AS t FROM documents
), pieces AS ({pieces}
), placed AS (
  SELECT doc_id, kind, i, v, coalesce(sum(length(v)) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM (SELECT doc_id, kind, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS v FROM pieces WHERE len(p) > 1)
), found AS (
  SELECT doc_id, kind, CAST(s AS BIGINT) AS s, CAST(s + length(v) AS BIGINT) AS e FROM placed
  WHERE i % 2 = 0 AND (kind <> 0 OR length(regexp_extract(v, '{value}', 1)) >= 6)
    AND (kind <> 4 OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')))
), parts AS (
  SELECT * FROM found f WHERE kind <> 4 OR NOT EXISTS (SELECT 1 FROM found b WHERE b.doc_id = f.doc_id AND b.kind < 3 AND b.s < f.e AND f.s < b.e)
), pairs AS (
  SELECT n.doc_id, n.kind AS n_kind, n.s AS n_s, n.e AS n_e, x.kind, x.s, x.e FROM parts n JOIN parts x
  ON n.doc_id = x.doc_id AND n.kind IN (1, 3) AND x.kind IN (0, 2, 4) AND x.s <= n.e + 200 AND x.e >= n.s - 200
), linked AS (SELECT doc_id, n_kind AS kind, n_s AS s, n_e AS e FROM pairs UNION SELECT doc_id, kind, s, e FROM pairs
), spans AS (
  SELECT doc_id, kind, s, e FROM parts WHERE kind < 3
  UNION SELECT doc_id, kind, s, e FROM linked
  UNION SELECT p.doc_id, p.kind, p.s, p.e FROM parts p JOIN linked l ON p.doc_id = l.doc_id AND p.kind = 5 AND p.s <= l.e + 200 AND p.e >= l.s - 200
), texts AS (SELECT *, ['assign', 'access', 'hex', 'ident', 'opaque', 'endpoint'][kind + 1] || ':' || s || ':' || e AS t FROM spans)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(x.t, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(x.t, ',' ORDER BY s, kind), '') AS spans
FROM documents d LEFT JOIN texts x USING (doc_id) GROUP BY d.doc_id
"""


OP8 = _op8()


OP11 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), tokens AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), groups AS (SELECT DISTINCT lang, source FROM docs
), kept AS (SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT i) >= 3
), counts AS (SELECT lang, source, term, count(*) AS c FROM tokens JOIN kept USING (lang, term) GROUP BY ALL
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0)::HUGEINT AS c FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term
), of_group AS (
  SELECT lang, source, term, c, 1 + (1000000000 * (c + 1)) // (sum(c) OVER w + count(*) OVER w) AS p FROM dense WINDOW w AS (PARTITION BY lang, source)
), of_lang AS (
  SELECT lang, term, 1 + (1000000000 * (c + 1)) // (sum(c) OVER w + count(*) OVER w) AS q
  FROM (SELECT lang, term, sum(c)::HUGEINT AS c FROM dense GROUP BY lang, term) WINDOW w AS (PARTITION BY lang)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM of_group a JOIN of_group b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), valued AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM of_group JOIN of_lang USING (lang, term) WHERE c > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM valued)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""


OP12 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), firsts AS (SELECT t, min(doc_id) AS first FROM docs GROUP BY t
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS f
  FROM docs JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), kinds AS (SELECT part, f, good, toxic, count(*) AS n FROM failed GROUP BY ALL
), runs AS (
  SELECT part, filter_order, good, toxic, n, f, list_position([f[ascii(filter_order[i]) - 64] FOR i IN [1, 2, 3, 4, 5]], true) AS falls FROM kinds, orders
), steps AS (
  SELECT part, filter_order, step, coalesce(sum(n) FILTER (falls IS NULL OR falls > step), 0) AS kept, coalesce(sum(n) FILTER (falls = step), 0) AS removed,
    coalesce(sum(n) FILTER (falls < step AND f[ascii(filter_order[step]) - 64]), 0) AS redundant,
    coalesce(sum(n) FILTER (falls = step AND len(list_filter(f, lambda y: y)) = 1), 0) AS unique_fails,
    coalesce(sum(n) FILTER (falls = step AND good), 0) AS good_lost, coalesce(sum(n) FILTER (falls = step AND toxic), 0) AS toxic_lost
  FROM runs, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM steps
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_revisit": OP1,
        "op3_url_lists": OP3,
        "op8_secret_scan": OP8,
        "op9_minhash_near_dedup": OP9,
        "op11_source_divergence": OP11,
        "op12_filter_audit": OP12,
    }
