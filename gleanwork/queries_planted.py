"""Pages of the test table with planted marks of platforms, and SQL that holds the registry's rules against them.

The page's id decides which marks it gets: of one platform a host, a script, a
path, metadata; of a second one anchors, structured data, a canonical link, a
text; and marks of single rules. The SQL starts from what was planted and has
the rules' sources, points, tiers and order as values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.fixtures import sql_value
from gleanwork.operators import detect as D
from gleanwork.plans.registry import ATS, INDEX, all_rules
from gleanwork.queries import Query, table

#: Paths of single platforms, and what each rule on them matches; gated rules need the platform's host.
PATHS = [
    ("workday", "/job/oslo/baker", [("workday.job_path", "/job/oslo/", True)]),
    ("breezy", "/p/7c1d", [("breezy.position_path", "/p/7c1d", True)]),
    ("personio", "/job/901", [("personio.job_path", "/job/901", True)]),
    ("icims", "/jobs/31/baker/job", [("icims.job_path", "/jobs/31/baker/job", True)]),
    ("bamboohr", "/careers/52", [("bamboohr.job_path", "/careers/52", True)]),
    ("teamtailor", "/jobs/440-baker", [("teamtailor.job_path", "/jobs/440-baker", True), ("teamtailor.job_path_generic", "/jobs/440-baker", False)]),
    ("taleo", "/careersection/2/jobdetail.ftl", [("taleo.careersection", "/careersection/", False), ("taleo.jobdetail", "jobdetail.ftl", False)]),
    ("successfactors", "/sf/recruiting/9", [("successfactors.recruiting_path", "/sf/recruiting/", False)]),
    ("jazzhr", "/apply/ab9", [("jazzhr.apply_path", "/apply/ab9", True)]),
]
#: Marks of single rules at an id modulo 13: rule, what it matches, markup.
MARKS = [
    (4, "jobvite.careersite_class", "jv-careersite", '<b class="JV-Careersite">x</b>'),
    (6, "workday.automation_id", "data-automation-id=jobpostingheader", '<i data-automation-id="jobPostingHeader"></i>'),
    (8, "recruitee.js_global", "window.recruitee", "<script>Window.Recruitee = {}</script>"),
    (10, "personio.iframe", "personio-iframe", '<div id="personio-iframe"></div>'),
]


def planted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, url, html`` with the marks in front of the page's own markup."""
    n, k = len(ATS), F.col("page_id")
    platforms = spark.createDataFrame([(i, a.hosts[0] if a.hosts else None, a.assets[0], a.terms[0]) for i, a in enumerate(ATS)], "i long, host string, asset string, term string")
    paths = spark.createDataFrame([(INDEX[a], p) for a, p, _ in PATHS], "i long, path string")
    first = platforms.join(paths, "i", "left")
    second = platforms.select(F.col("i").alias("j"), F.col("asset").alias("asset2"), F.col("term").alias("term2"))
    pages = table(spark, sf_dir, "pages").withColumn("i", k % n).withColumn("j", (F.col("i") + 1 + F.floor(k / n) % 5) % n)
    pages = pages.join(F.broadcast(first), "i").join(F.broadcast(second), "j")
    c = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    num = k.cast("string")
    root = F.when((k % 3 == 0) & F.col("host").isNotNull(), c("https://b", num, ".", F.col("host"))).otherwise(F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0))
    path = F.when(k % 4 == 1, F.coalesce("path", F.lit("/x"))).otherwise(F.lit("/x"))
    url = c(root, path, F.when(k % 17 == 5, c("?gh_jid=", num)).otherwise(F.lit("")))
    anchors = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda m: (m > 0) & (m <= k % 5)), lambda m: c('<a href="https://w', m.cast("string"), ".", F.col("asset2"), "/", m.cast("string"), '">go</a>')), "")
    vendor = c("<script src=\"https://s1.vendor", (k % 4).cast("string"), '.io/a.js"></script><script src="https://s2.vendor', (k % 4).cast("string"), '.io/b.js"></script>')
    marks = [
        F.when(k % 2 == 0, c('<script src="https://cdn', num, ".", F.col("asset"), '/a.js"></script>')), anchors,
        F.when((k % 7).isin(1, 2), c('<script type="application/ld+json">{"sameAs": "https://u.', F.col("asset2"), '/"}</script>')),
        F.when(k % 11 == 3, c('<link rel="canonical" href="https://c.', F.col("asset2"), '/">')),
        F.when(k % 6 == 2, c('<meta name="generator" content="made by ', F.col("term"), '">')), F.when(k % 6 == 5, c("<p>Runs on ", F.col("term2"), ".</p>")),
        F.when(k % 9 == 4, vendor), *[F.when(k % 13 == m, F.lit(markup)) for m, _, _, markup in MARKS],
    ]
    return pages.select("page_id", url.alias("url"), F.concat(*[F.coalesce(m, F.lit("")) for m in marks], "html").alias("html"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(sql_value, r)) + ")" for r in rows)


_N = len(ATS)
_PLANTED = "\n  UNION ALL ".join([
    "SELECT k, name || '.hostname' AS signal_id, 'b' || k || '.' || host AS matched FROM b WHERE on_host",
    "SELECT k, name || '.script_src', 'https://cdn' || k || '.' || asset || '/a.js' FROM b WHERE k % 2 = 0",
    "SELECT k, name2 || '.anchor', 'https://w1.' || asset2 || '/1' FROM b WHERE k % 5 >= 3",
    "SELECT k, name2 || '.jsonld', 'https://u.' || asset2 || '/' FROM b WHERE k % 7 IN (1, 2)",
    "SELECT k, name2 || '.canonical', 'https://c.' || asset2 || '/' FROM b WHERE k % 11 = 3",
    "SELECT k, o.name || '.meta', 'generator=made by ' || b.term FROM b JOIN terms o ON contains('generator made by ' || b.term, o.term) WHERE k % 6 = 2",
    "SELECT DISTINCT k, o.name || '.text', o.term FROM b JOIN terms o ON contains('runs on ' || b.term2 || '.', o.term) WHERE k % 6 = 5",
    "SELECT k, 'greenhouse.gh_jid', 'gh_jid=' || k FROM b WHERE k % 17 = 5",
    "SELECT k, signal_id, matched FROM b JOIN marks ON k % 13 = m",
    "SELECT k, signal_id, matched FROM b JOIN paths USING (i) WHERE k % 4 = 1 AND (on_host OR NOT gated)",
])
EVIDENCE = f"""platforms(i, name, host, asset, term) AS (VALUES {_values([(i, a.name, a.hosts[0] if a.hosts else None, a.assets[0], a.terms[0]) for i, a in enumerate(ATS)])}),
terms(name, term) AS (VALUES {_values([(a.name, t) for a in ATS for t in a.terms])}),
rules(rule_idx, signal_id, ats, ats_idx, source, points, tier) AS (VALUES {_values([(n, r.signal_id, r.ats, INDEX[r.ats], r.source, r.points, r.tier) for n, r in enumerate(all_rules())])}),
paths(i, signal_id, matched, gated) AS (VALUES {_values([(INDEX[a], s, m, g) for a, _, found in PATHS for s, m, g in found])}),
marks(m, signal_id, matched) AS (VALUES {_values([x[:3] for x in MARKS])}),
b AS (SELECT page_id AS k, p.*, q.name AS name2, q.asset AS asset2, q.term AS term2, page_id % 3 = 0 AND p.host IS NOT NULL AS on_host
  FROM pages JOIN platforms p ON page_id % {_N} = p.i JOIN platforms q ON (page_id % {_N} + 1 + page_id // {_N} % 5) % {_N} = q.i),
planted AS ({_PLANTED}),
fired AS (SELECT k, rules.*, matched FROM planted JOIN rules USING (signal_id)),
capped AS (SELECT *, greatest(0, least(points, 70 - least(70, coalesce(sum(points) OVER (PARTITION BY k, ats, source ORDER BY rule_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))) AS allowed FROM fired)"""

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


@query(f"""WITH {EVIDENCE}
SELECT k AS page_id, CAST(row_number() OVER (PARTITION BY k ORDER BY tier, allowed DESC, rule_idx) - 1 AS BIGINT) AS pos, signal_id, source, CAST(allowed AS BIGINT) AS points, CAST(tier AS BIGINT) AS tier, matched FROM capped WHERE allowed > 0""")
def planted_evidence(spark, sf_dir):
    """What fires on the planted pages, with the points that count, strongest first."""
    rows = D.evidence_list(D.capped_points(D.fired_rules(D.extract_signals(planted_pages(spark, sf_dir)))))
    return rows.select("page_id", F.posexplode("evidence").alias("pos", "e")).select("page_id", F.col("pos").cast("long").alias("pos"), "e.signal_id", "e.source", "e.points", F.col("e.tier").cast("long").alias("tier"), "e.matched")


@query(f"""WITH {EVIDENCE},
scored AS (SELECT k, ats, ats_idx, least(sum(allowed), 100) AS score, count(DISTINCT source) AS sources, count(DISTINCT CASE WHEN tier <= 1 THEN source END) AS tier1,
  count(DISTINCT CASE WHEN tier <= 2 THEN source END) AS tier2, bool_or(source = 'hostname') AS has_host FROM capped WHERE allowed > 0 GROUP BY k, ats, ats_idx),
owned AS (SELECT *, min(CASE WHEN has_host THEN ats_idx END) OVER (PARTITION BY k) AS owner FROM scored),
ranked AS (SELECT *, row_number() OVER w AS r, lead(ats) OVER w AS second, coalesce(lead(score) OVER w, 0) AS second_score, coalesce(lead(tier2) OVER w, 0) AS second_tier2
  FROM owned WINDOW w AS (PARTITION BY k ORDER BY coalesce(ats_idx = owner, false) DESC, score DESC, ats_idx)),
judged AS (SELECT *, CASE WHEN tier1 = 0 AND tier2 < 2 THEN 'unknown' WHEN owner IS NULL AND second_tier2 > 0 AND second_score >= 0.6 * score THEN 'ambiguous' ELSE 'detected' END AS status,
  CASE WHEN tier1 > 0 THEN 1.0::DOUBLE WHEN tier2 > 0 THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END AS quality, CAST(score - second_score AS DOUBLE) / CAST(score AS DOUBLE) AS margin,
  least(CAST(sources AS DOUBLE) / 3, 1) AS diversity FROM ranked WHERE r = 1)
SELECT page_id, CASE WHEN status = 'detected' THEN ats END AS detected_ats, coalesce(status, 'unknown') AS status, CAST(coalesce(score, 0) AS BIGINT) AS score,
  round(CASE WHEN score IS NULL THEN 0 WHEN status = 'detected' THEN greatest(0, least(1, 0.4::DOUBLE * quality + 0.3::DOUBLE * margin + 0.3::DOUBLE * diversity)) ELSE 0.2::DOUBLE * quality + 0.2::DOUBLE * diversity END, 3) AS confidence,
  CASE WHEN status = 'ambiguous' THEN ats || ',' || second END AS conflicts,
  CASE WHEN coalesce(status, 'unknown') = 'unknown' AND page_id % 9 = 4 THEN 'vendor' || (page_id % 4) || '.io' END AS unknown_vendor
FROM pages LEFT JOIN judged ON page_id = k""")
def planted_verdicts(spark, sf_dir):
    """Verdicts on the planted pages: winners, rivals, capped scores, confidence, unknown vendors."""
    rows = D.detect(planted_pages(spark, sf_dir))
    return rows.select("page_id", "detected_ats", "status", "score", "confidence", F.array_join("conflicts", ",").alias("conflicts"), "unknown_vendor")
