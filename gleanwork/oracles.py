"""DuckDB SQL with the results that the registered queries must give."""

from __future__ import annotations


WORDS = "('that', 'tion', 'ention', 'thatin')"
JOB_SHAPE = (
    r"(?i)/(?:[\p{L}\p{N}_]+-)?(?:jobs?|offres?|offers?|emplois?|postes?|annonces?|vacanc(?:y|ies)|positions?|openings?|opportunit(?:y|ies)|careers?|carrieres?|stellen?|recrutement)"
    r"(?:-d?-?(?:jobs?|offres?|offers?|emplois?|postes?|annonces?|vacanc(?:y|ies)|positions?|openings?|opportunit(?:y|ies)|careers?|carrieres?|stellen?|recrutement))?(?:/[^/?#]+){0,2}/(?:[^/?#]*[-_][^/?#]*|\d{3,})"
)
ANCHOR = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\s>]+))[^>]*>"


def hits(column: str, words: str = WORDS) -> str:
    return rf"len(list_filter(regexp_split_to_array(lower({column}), '[^\p{{L}}\p{{N}}_]+'), lambda x: x IN {words}))"


POSTINGS = (
    "p AS (SELECT doc_id, source AS company, CASE WHEN doc_id % 7 = 0 THEN '' ELSE split_part(text, chr(10), 1) END AS title, "
    "'https://' || source || '.example.com/jobs/' || doc_id AS url, text AS description FROM documents)"
)
JOBS = f"{POSTINGS}, j AS (SELECT doc_id AS id, company, title, description, url, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * (doc_id % 720) AS timestamp FROM p)"
ANALYSES = "a AS (SELECT doc_id AS id, CAST(quality * 60 + toxic * 5 + doc_id % 30 AS INTEGER) AS adequation_grade, 'text' AS depth_analysis, 'model' AS ai_model, doc_id AS job_id FROM labels)"
BOTH = f"WITH {JOBS}, {ANALYSES}"
BLANK = r"(regexp_replace({0}, '^\s+|\s+$', '', 'g') IN ('', 'nan'))"
HOST = r"lower(split_part(regexp_replace(regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1), '^.*@', ''), ':', 1))"
DIAGNOSED = rf"""d AS (
  SELECT page_id, html, len(regexp_extract_all(html, '{ANCHOR}')) AS anchors, len(regexp_extract_all(html, '(?i)<script[\s>]')) AS scripts,
    CASE {' '.join(f"WHEN contains(html, '{m.replace(chr(39), chr(39) * 2)}') THEN '{m.replace(chr(39), chr(39) * 2)}'" for m in ('id="root"', "id='root'", 'id="app"', "id='app'", 'id="__next"', "id='__next'", '__NEXT_DATA__', '__INITIAL_STATE__', '__NUXT__'))} END AS marker,
    len(list_filter(list_transform(regexp_extract_all(html, '{ANCHOR}'), lambda x: concat(regexp_extract(x, '{ANCHOR}', 1), regexp_extract(x, '{ANCHOR}', 2), regexp_extract(x, '{ANCHOR}', 3))), lambda u: regexp_matches(u, '{JOB_SHAPE}'))) > 0 AS job_links
  FROM pages), c AS (
  SELECT *, CASE WHEN regexp_full_match(html, '\s*') THEN 'empty body' WHEN job_links THEN 'job-shaped links present but no strategy read them'
    WHEN marker IS NOT NULL OR (anchors < 15 AND scripts >= 10) THEN 'likely javascript-rendered' WHEN anchors = 0 THEN 'no links on the page' ELSE 'no job-shaped links' END AS cause FROM d)"""

ORACLES: dict[str, str] = {
    "keyword_hits": f"WITH {POSTINGS} SELECT doc_id, CAST({hits('title')} + {hits('description')} AS BIGINT) AS hits FROM p",
    "blacklist_filter": f"WITH {POSTINGS} SELECT doc_id FROM p WHERE {hits('title', chr(40) + chr(39) + 'was' + chr(39) + chr(41))} + {hits('description', chr(40) + chr(39) + 'was' + chr(39) + chr(41))} = 0",
    "recover_titles": "SELECT page_id, 'Senior Dev ' || page_id AS title FROM pages",
    "first_filter": f"""WITH {POSTINGS}, h AS (SELECT *, {hits('title')} + {hits('url')} AS n FROM p WHERE {hits('title', "('was')")} + {hits('url', "('was')")} = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY md5(url), url) AS k FROM h WHERE n < 2 AND {BLANK.format('title')} AND company IS NOT NULL)
        SELECT doc_id, company, title, url FROM h WHERE n >= 2 UNION ALL SELECT doc_id, company, title, url FROM r WHERE k <= 300""",
    "second_filter": f"""WITH {POSTINGS}, h AS (SELECT *, {hits('title')} + {hits('url')} + {hits('description')} AS n FROM p
        WHERE {hits('title', "('idiot')")} + {hits('url', "('idiot')")} + {hits('description', "('idiot')")} = 0 AND NOT {BLANK.format('description')})
        SELECT doc_id, title, CAST(n AS BIGINT) AS keyword_hits FROM h WHERE n >= CASE WHEN {BLANK.format('title')} OR {BLANK.format('url')} THEN 3 ELSE 5 END""",
    "capped_exemption": f"WITH {POSTINGS} SELECT doc_id, company FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY md5(url), url) AS k FROM p WHERE company IS NOT NULL) WHERE k <= 10",
    "dedupe_by_url": "SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(split_part(url, '#', 1), '/+$', '') ORDER BY page_id) AS k FROM (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000000, url || CASE WHEN page_id % 2 = 0 THEN '#apply' ELSE '/' END FROM pages)) WHERE k = 1",
    "url_parts": rf"""WITH u AS (SELECT page_id, url, {HOST.format('url')} AS host FROM pages)
        SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme, host, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path,
        regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query, regexp_extract(host, '([^.]+\.)?[^.]+$') AS domain, regexp_replace(split_part(url, '#', 1), '/+$', '') AS norm FROM u""",
    "page_titles": r"SELECT page_id, nullif(trim(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), '') AS title FROM pages",
    "page_shapes": f"WITH {DIAGNOSED} SELECT page_id, CAST(anchors AS BIGINT) AS anchors, CAST(scripts AS BIGINT) AS scripts, marker FROM c",
    "diagnose_verdict": f"WITH {DIAGNOSED} SELECT page_id, cause FROM c",
    "miss_report": f"WITH {DIAGNOSED} SELECT cause AS label, count(*) AS n FROM c GROUP BY cause",
    "pending_analysis": f"{BOTH} SELECT id, company, title FROM j WHERE id NOT IN (SELECT job_id FROM a) AND timestamp >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY",
    "pending_count": f"{BOTH} SELECT count(*) AS pending FROM j WHERE id NOT IN (SELECT job_id FROM a) AND timestamp >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 30 DAY",
    "not_in_with_null": f"{BOTH} SELECT id FROM j WHERE id NOT IN (SELECT job_id FROM a UNION ALL SELECT NULL)",
    "job_state_flags": f"{BOTH} SELECT id, EXISTS (SELECT 1 FROM a WHERE a.job_id = j.id) AS is_graded FROM j",
    "point_lookup": f"WITH {JOBS} SELECT id, company, url FROM j WHERE url = 'https://src3.example.com/jobs/3'",
    "graded_join": f"{BOTH} SELECT j.id, adequation_grade, company, title, url, ai_model, timestamp FROM a JOIN j ON j.id = a.job_id",
    "cv_queue": f"{BOTH} SELECT j.id, adequation_grade, company, title, CAST(NULL AS VARCHAR) AS place, url FROM a JOIN j ON j.id = a.job_id WHERE j.id NOT IN (SELECT job_id FROM a WHERE job_id % 3 = 0) AND adequation_grade >= 70",
    "generated_documents": f"{BOTH} SELECT a.id, title, company, adequation_grade, 'en' AS locale, url FROM a JOIN j ON j.id = a.job_id WHERE a.job_id % 3 = 0",
    "generation_row": f"{BOTH} SELECT md5(description) AS digest, a.id AS analysis_id, depth_analysis FROM a JOIN j ON j.id = a.job_id WHERE j.id = 1",
    "three_way_join": "SELECT c_mktsegment, count(*) AS n, count(DISTINCT o_orderkey) AS n_orders, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "insert_ignore": f"""WITH {POSTINGS}, b AS (SELECT doc_id AS pos, company, md5(description) AS url FROM p), s AS (SELECT doc_id AS id, md5(description) AS url FROM p WHERE doc_id % 5 = 0),
        f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS k FROM b) WHERE k = 1 AND url NOT IN (SELECT url FROM s))
        SELECT (SELECT max(id) FROM s) + row_number() OVER (ORDER BY pos) AS id, pos, company, url FROM f""",
    "insert_counts": f"""WITH {POSTINGS}, f AS (SELECT DISTINCT md5(description) AS url FROM p WHERE md5(description) NOT IN (SELECT md5(description) FROM p WHERE doc_id % 5 = 0))
        SELECT (SELECT count(*) FROM f) AS inserted, (SELECT count(*) FROM p) - (SELECT count(*) FROM f) AS skipped""",
    "resume_anti": f"WITH {POSTINGS} SELECT doc_id, url FROM p WHERE NOT EXISTS (SELECT 1 FROM p AS q WHERE q.doc_id % 4 = 1 AND q.url = p.url)",
    "funnel_counts": f"WITH {POSTINGS} SELECT count(*) AS kept, count(*) FILTER (doc_id % 4 <> 0) AS todo, count(*) FILTER (doc_id % 4 <> 0 AND doc_id % 3 <> 0) AS fresh FROM p",
    "value_counts_top": "SELECT coalesce(CASE WHEN event_id % 11 > 0 THEN event_type END, '(blank)') AS label, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, label LIMIT 4",
    "mean_median": "SELECT round(CAST(avg(o_totalprice) AS DOUBLE), 4) AS mean, round(CAST(median(o_totalprice) AS DOUBLE), 4) AS median FROM orders",
    "group_mean_top15": f"{BOTH} SELECT company AS label, avg(adequation_grade) AS mean FROM j JOIN a ON j.id = a.job_id GROUP BY company ORDER BY mean DESC, label LIMIT 15",
    "grade_histogram": f"WITH {ANALYSES}, b AS (SELECT unnest(range(20)) AS bin) SELECT CAST(bin * 5 AS BIGINT) AS low, (SELECT count(*) FROM a WHERE adequation_grade BETWEEN 0 AND 100 AND least(adequation_grade // 5, 19) = bin) AS n FROM b",
    "nlargest_15": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 15",
    "distinct_counts": "SELECT count(DISTINCT user_id) AS n_user_id, count(DISTINCT event_type) AS n_event_type FROM events",
    "per_board_counts": f"WITH p AS (SELECT html, {HOST.format('url')} AS h FROM pages) SELECT h AS url, CASE WHEN count(*) FILTER (length(html) > 9000) = 0 THEN count(*) END AS n FROM p GROUP BY h",
    "first_strategy": """WITH s AS (SELECT page_id AS id, 'b' || (page_id % 40) AS board_url, CASE WHEN page_id % 3 = 0 THEN 'links' WHEN page_id % 7 = 0 THEN 'sitemap' ELSE 'rendered' END AS via FROM pages),
        r AS (SELECT *, CASE via WHEN 'sitemap' THEN 2 WHEN 'links' THEN 3 ELSE 4 END AS k FROM s) SELECT id, board_url, via FROM (SELECT *, min(k) OVER (PARTITION BY board_url) AS m FROM r) WHERE k = m""",
    "host_sample": f"SELECT page_id, host FROM (SELECT page_id, {HOST.format('url')} AS host, row_number() OVER (PARTITION BY {HOST.format('url')} ORDER BY page_id % 5 = 0 DESC, md5(url), url) AS k FROM pages) WHERE k <= 2",
    "json_path": "SELECT event_id, props->>'$.k' AS k, props->>'$.k' AS k_text FROM events",
    "capped_scores": """WITH l AS (SELECT l_orderkey AS page_id, 'a' || (l_partkey % 3) AS ats, l_returnflag AS source, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + CAST(floor(l_quantity) AS BIGINT) AS k, CAST(floor(l_quantity) AS INTEGER) AS points FROM lineitem),
        u AS (SELECT *, least(70, coalesce(sum(points) OVER (PARTITION BY page_id, ats, source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS used FROM l),
        w AS (SELECT *, greatest(0, least(points, 70 - used)) AS allowed FROM u)
        SELECT page_id, ats, CAST(least(sum(allowed), 100) AS BIGINT) AS score, count(*) AS n_evidence FROM w WHERE allowed > 0 GROUP BY page_id, ats""",
    "accuracy_report": """WITH l AS (SELECT 'q' || quality AS e, 'q' || toxic AS p FROM labels), c AS (SELECT unnest(['q0', 'q1']) AS label), n AS (
        SELECT label, (SELECT count(*) FROM l WHERE e = label AND p = label) AS tp, (SELECT count(*) FROM l WHERE e <> label AND p = label) AS fp, (SELECT count(*) FROM l WHERE e = label AND p <> label) AS fn FROM c)
        SELECT label, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM n""",
    "look_back_window": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR",
    "fixture_names": r"""SELECT page_id, trim(regexp_replace((CASE WHEN page_id % 2 = 0 THEN 'lever' ELSE 'none' END) || '_' || replace(lower(regexp_extract(url, '//([^/?#]*)', 1)), ':', '_'), '[^a-z0-9]+', '_', 'g'), '_')
        || '_' || substr(sha1(url), 1, 8) || '.html' AS name FROM pages""",
    "reason_lines": f"WITH {DIAGNOSED} SELECT page_id, cause, CAST(anchors AS DOUBLE) AS anchors, CAST(scripts AS DOUBLE) AS scripts FROM c",
    "rejected_negatives": "SELECT count(*) FILTER (quality = 0) AS negatives, count(*) FILTER (quality = 0 AND toxic = 0) AS rejected FROM labels",
    "host_suffix_join": f"""WITH h AS (SELECT page_id, {HOST.format('url')} AS host FROM pages), k AS (SELECT DISTINCT regexp_extract(host, '([^.]+\\.)?[^.]+$') AS domain FROM h)
        SELECT page_id, domain FROM h JOIN k ON host = domain OR ends_with(host, '.' || domain)""",
    "reindexed_columns": f"WITH {JOBS} SELECT coalesce(company, '') AS company, '' AS place, '' AS via FROM j",
    "via_counts": "SELECT role AS via, count(*) AS n FROM conversations GROUP BY role",
    "deduplicated_stream": "SELECT DISTINCT user_id FROM events",
    "streaming_resume": "SELECT event_id, user_id, event_type FROM events WHERE event_type IS NOT NULL",
}
