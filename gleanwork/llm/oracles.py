"""DuckDB SQL of the queries that SQL can express."""

SPACE = r"[ \t\n\x0B\f\r]"
WORD = r"[^ \t\n\x0B\f\r]+"

MIX = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, 2 * source_size AS cap, CAST((sum(source_size) OVER ()) AS BIGINT) * 150 / 100.0 AS budget,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM per_source
), levels AS (
  SELECT *, (CAST(budget AS DOUBLE) - CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) AS target FROM levels
), rated AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size * 16777216 + 0.5) AS BIGINT) ELSE 0 END AS rate,
    s.class,
    CAST(('0x' || substr(md5('20:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) % greatest(1, CAST(floor(s.n_class / 1000) AS BIGINT)) AS grp,
    CAST(('0x' || substr(md5('20:' || coalesce(s.source, '')), 1, 6)) AS BIGINT) AS shift
  FROM (SELECT *, count(*) OVER (PARTITION BY source, class) AS n_class FROM
    (SELECT *, CASE WHEN size > 0 THEN CAST(floor(log2(size) * 4) AS INTEGER) ELSE -1 END AS class FROM sized)) s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), summed AS (
  SELECT *, shift + CAST(sum(rate) OVER (PARTITION BY source ORDER BY class, grp, size, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM rated
)
SELECT doc_id, size, source_size, target, ((upto >> 24) - ((upto - rate) >> 24)) * size AS taken FROM summed
"""

WARC = """
WITH p AS (
  SELECT page_id, CAST(coalesce(strlen(html), 0) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS payload FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, regexp_extract_all(text, '{WORD}') AS w FROM d),
win AS (
  SELECT r, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)
),
often AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM win) WHERE k > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY r),
lines AS (SELECT r, doc_id, host, text, pos, line FROM (SELECT r, doc_id, host, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d)
  WHERE regexp_matches(line, '{WORD}')),
dup AS (SELECT r, CAST(sum(k - 1) AS BIGINT) AS n FROM (SELECT r, line, count(*) AS k FROM lines GROUP BY r, line) GROUP BY r),
normal AS (SELECT r, host, doc, doc_id, lower(array_to_string(w, ' ')) AS norm, len(w) AS n FROM
  (SELECT r, host, doc_id, coalesce(CAST(doc_id AS VARCHAR), 'text:' || text) AS doc, regexp_extract_all(line, '{WORD}') AS w FROM lines)),
hosts AS (SELECT host, count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'text:' || text)) AS n FROM d GROUP BY host),
freq AS (SELECT s.host, s.norm, min(s.doc_id) AS first_doc FROM normal s JOIN hosts h ON s.host IS NOT DISTINCT FROM h.host
  GROUP BY s.host, s.norm, h.n HAVING count(DISTINCT s.doc) >= 20 AND count(DISTINCT s.doc) >= least(0.005 * h.n, 1000)),
lost AS (SELECT s.r, CAST(sum(s.n) AS BIGINT) AS n FROM normal s JOIN freq f ON s.norm = f.norm AND s.host IS NOT DISTINCT FROM f.host WHERE s.doc_id IS DISTINCT FROM f.first_doc GROUP BY s.r),
base AS (
  SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost.n, 0) AS lost_words
  FROM d JOIN words USING (r) LEFT JOIN dup USING (r) LEFT JOIN covered USING (r) LEFT JOIN lost USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_words <= 0.5 * n_words AS kept, lost_words
FROM base
"""

SNAPSHOTS = """
WITH cased AS (
  SELECT doc_id, text, lang, source, coalesce(CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST(range(8) AS BIGINT[])),
    lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 10 AS INTEGER), 9) AS k FROM documents
), later AS (
  SELECT CASE WHEN k IN (3, 4) THEN -1 - doc_id ELSE doc_id END AS id, CASE WHEN k = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
    CASE WHEN k = 2 THEN source ELSE lang END AS lang, CASE WHEN k = 2 THEN lang WHEN k = 4 THEN NULL ELSE source END AS source FROM cased WHERE k <> 0
  UNION ALL SELECT -1 - doc_id, text, lang, source FROM cased WHERE k = 5
), n AS (
  SELECT id, text, lang, source, sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~')) AS sha FROM later
), o AS (SELECT doc_id AS id, text, lang, source FROM documents),
met AS (
  SELECT n.id AS key, o.id AS old_key, concat_ws(',', CASE WHEN o.text IS DISTINCT FROM n.text THEN 'text' END,
    CASE WHEN o.lang IS DISTINCT FROM n.lang THEN 'lang' END, CASE WHEN o.source IS DISTINCT FROM n.source THEN 'source' END) AS changed, sha
  FROM o JOIN n ON o.id IS NOT DISTINCT FROM n.id
), o1 AS (SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY id) AS i FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id IS NOT DISTINCT FROM o.id)),
n1 AS (SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY id DESC) AS i FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE n.id IS NOT DISTINCT FROM o.id))
SELECT key, old_key, CASE WHEN changed = '' THEN 'same' ELSE 'update' END AS op, changed, sha AS row_sha256 FROM met
UNION ALL
SELECT coalesce(n1.id, o1.id), o1.id, CASE WHEN o1.i IS NULL THEN 'insert' WHEN n1.i IS NULL THEN 'delete' ELSE 'rekey' END, '', n1.sha
FROM o1 FULL JOIN n1 ON o1.i = n1.i AND o1.text IS NOT DISTINCT FROM n1.text AND o1.lang IS NOT DISTINCT FROM n1.lang AND o1.source IS NOT DISTINCT FROM n1.source
"""

ORACLES = {"op12_snapshot_diff": SNAPSHOTS, "op1_mix_sources": MIX, "op8_quality_rules": QUALITY, "op10_warc": WARC}
