"""Registered queries in which the pages of the test tables carry known cases, each with its SQL beside it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork import fixtures as X
from gleanwork.cases import OWNED_SQL, all_cases, all_cases_sql, one_case, one_case_sql, owned, results_sql
from gleanwork.functions import html as H
from gleanwork.functions import jsonx as J
from gleanwork.functions import urls as U
from gleanwork.operators import detect as D
from gleanwork.operators import details, documents, reports, store
from gleanwork.plans.registry import ATS, FEEDS, platform_readers
from gleanwork.queries import Query
from gleanwork.sources import connectors as C
from gleanwork.sources import fetches as FT

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def keep(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def ok(rows: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """Successful fetches."""
    return rows.select(F.col(url).alias("url"), F.lit(200).alias("status"), F.col(body).alias("body"))


# --- URLs ----------------------------------------------------------------------


@query(one_case_sql("url, title", X.TITLES))
def title_from_url(spark, sf_dir):
    return one_case(spark, sf_dir, X.TITLES, "url string, expected string").select("page_id", "url", U.title_from_url("url").alias("title"))


@query(one_case_sql("path, is_posting", X.POSTING_PATHS))
def posting_url_shape(spark, sf_dir):
    return one_case(spark, sf_dir, X.POSTING_PATHS, "path string, expected boolean").select("page_id", "path", U.is_posting_path("path").alias("is_posting"))


@query(one_case_sql("ats, url, is_posting", X.SHAPED))
def vendor_shape(spark, sf_dir):
    met = one_case(spark, sf_dir, X.SHAPED, "ats string, url string, expected boolean").join(F.broadcast(C.shapes_table(spark)), F.col("ats") == F.col("shape_ats"))
    return met.select("page_id", "ats", "url", F.rlike(U.link_target("url", F.col("match_query")), F.concat(F.lit("(?i)"), F.col("shape"))).alias("is_posting"))


@query(one_case_sql("url, ats", X.HOSTS))
def ats_from_host(spark, sf_dir):
    return one_case(spark, sf_dir, X.HOSTS, "url string, expected string").select("page_id", "url", U.ats_from_host("url").alias("ats"))


@query(one_case_sql("base, link, url", X.JOINS))
def url_resolution(spark, sf_dir):
    return one_case(spark, sf_dir, X.JOINS, "base string, link string, expected string").select("page_id", "base", "link", H.url_join("base", "link").alias("url"))


@query(one_case_sql("url, api", X.WORKDAY_URLS))
def workday_api(spark, sf_dir):
    return one_case(spark, sf_dir, X.WORKDAY_URLS, "url string, expected string").select("page_id", "url", U.workday_api("url").alias("api"))


@query(one_case_sql("ats, url, token", X.TOKENS))
def feed_tokens(spark, sf_dir):
    token = F.coalesce(*[F.when(F.col("ats") == f.ats, U.first_token([F.col("url")], f.tokens)) for f in FEEDS])
    return one_case(spark, sf_dir, X.TOKENS, "ats string, url string, expected string").select("page_id", "ats", "url", token.alias("token"))


# --- report lines and JSON --------------------------------------------------------


@query(one_case_sql("reason, cause, anchors, scripts, marker, redirect", X.REASONS))
def parse_reasons(spark, sf_dir):
    rows = one_case(spark, sf_dir, [x[:1] for x in X.REASONS], "reason string").select("page_id", "reason")
    return reports.parse_reasons(rows)


@query(f"SELECT CAST(count_if(page_id % {len(X.REASONS)} = 1) AS BIGINT) AS n_marker, CAST(count_if(page_id % {len(X.REASONS)} = 2) AS BIGINT) AS n_redirect FROM pages")
def non_null_counts(spark, sf_dir):
    rows = one_case(spark, sf_dir, [x[:1] for x in X.REASONS], "reason string")
    return reports.non_null_counts(reports.parse_reasons(rows), "marker", "redirect")


@query(one_case_sql("json, path, found", X.FIRST_STRINGS))
def json_first_string(spark, sf_dir):
    rows = one_case(spark, sf_dir, X.FIRST_STRINGS, "json string, path string, expected string")
    return rows.select("page_id", "json", "path", J.json_first_string("json", "path").alias("found"))


@query(one_case_sql("content_type, textual", X.CONTENT_TYPES))
def textual_types(spark, sf_dir):
    return one_case(spark, sf_dir, X.CONTENT_TYPES, "content_type string, expected boolean").select("page_id", "content_type", FT.is_textual(F.col("content_type")).alias("textual"))


@query(results_sql("url, status, error", [(0, "https://orchard/1", "unknown", "TimeoutError"), (1, "https://orchard/2", "unknown", "http 503")], 3).replace("SELECT page_id, ", "SELECT ", 1))
def failed_detections(spark, sf_dir):
    cases = [("https://orchard/1", None, "TimeoutError"), ("https://orchard/2", 503, None), ("https://orchard/3", 200, None)]
    return D.failed(one_case(spark, sf_dir, cases, "url string, status int, error string")).select("url", "status", "error")


# --- connectors ----------------------------------------------------------------------


def boards(rows: DataFrame, *more: str) -> DataFrame:
    """Boards of the cases; ``final_url`` and ``html`` are null where a case has none."""
    none = F.lit(None).cast("string")
    return rows.select("board_url", F.col("own").alias("company"), "ats", F.col("final_url") if "final_url" in more else none.alias("final_url"), F.col("html") if "html" in more else none.alias("html"))


@query(one_case_sql("title, place, url", [x[4:] for x in X.FEED_BOARDS]).replace("SELECT page_id, ", "SELECT own AS company, ", 1))
def feeds_of_all_vendors(spark, sf_dir):
    """A board of one of the platforms with a feed for each page."""
    rows = one_case(spark, sf_dir, [x[:4] for x in X.FEED_BOARDS], "ats string, board_url string, request string, body string")
    return C.feed_postings(boards(rows), ok(rows, "request")).select("company", "title", "place", "url")


@query(f"SELECT 'https://careers.smartrecruiters.com/' || own AS board_url, own AS company, 'Dev ' || own AS title, 'https://jobs.smartrecruiters.com/' || own || '/7' AS url, 'Paris' AS place, 'feed' AS via FROM ({OWNED_SQL})")
def feed_items(spark, sf_dir):
    """Items without id or title, and what is no item, are left out."""
    body = json.dumps({"totalFound": 2, "content": [{"id": 7, "name": "Dev orchard", "location": {"city": "Paris"}}, {"id": None, "name": "No id"}, {"id": 8, "name": " "}, "junk"]})
    rows = one_case(spark, sf_dir, [("https://careers.smartrecruiters.com/orchard", "smartrecruiters", "https://api.smartrecruiters.com/v1/companies/orchard/postings?limit=100", body)], "board_url string, ats string, request string, body string")
    return C.feed_postings(boards(rows), ok(rows, "request"))


@query(f"SELECT 'Job ' || i AS title, 'https://jobs.smartrecruiters.com/' || own || '/' || i AS url FROM ({OWNED_SQL}) CROSS JOIN (SELECT unnest(range(201)) AS i) WHERE i < 101 + page_id % 3 * 50")
def feed_paging(spark, sf_dir):
    """Pages of 100 follow until the total that the first one states."""
    root = "https://api.smartrecruiters.com/v1/companies/orchard/postings?limit=100"
    rows = all_cases(spark, sf_dir, [(0, root), (100, f"{root}&offset=100"), (200, f"{root}&offset=200")], "first long, request string")
    total = 101 + F.col("page_id") % 3 * 50
    item = lambda i: F.struct(i.alias("id"), F.concat(F.lit("Job "), i.cast("string")).alias("name"), F.lit("X").alias("location"))
    items = F.transform(F.filter(F.sequence(F.col("first"), F.col("first") + 99), lambda i: i < total), item)
    fetches = rows.withColumn("body", F.to_json(F.struct(total.alias("totalFound"), items.alias("content"))))
    own = one_case(spark, sf_dir, [("https://careers.smartrecruiters.com/orchard", "smartrecruiters")], "board_url string, ats string")
    return C.feed_postings(boards(own), ok(fetches, "request")).select("title", "url")


@query(all_cases_sql("pos, title, city, url", [(0, "Bake & Serve", "Oslo", "https://orchard/1"), (1, "Cook <2>", None, "https://orchard/2")]))
def xml_items(spark, sf_dir):
    rows = C.xml_records(one_case(spark, sf_dir, [(X.XML,)], "body string"), "job", ["title", "city", "url"])
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), F.col("item_title").alias("title"), F.col("item_city").alias("city"), F.col("item_url").alias("url"))


@query(one_case_sql("title, description, company, place", [("Ship Cook", "Fish & bread", "orchard Line", "Bergen")]))
def jsonld_postings(spark, sf_dir):
    page = one_case(spark, sf_dir, [(X.JSONLD_PAGE,)], "html string").select("page_id", H.extract_detail("html").alias("d"))
    return page.select("page_id", "d.jsonld.title", "d.jsonld.description", "d.jsonld.company", "d.jsonld.place")


@query(all_cases_sql("pos, url", [(0, "https://orchard.fr/jobs/1-dev"), (1, "https://orchard.fr/jobs/2-ops"), (2, "https://orchard.fr/jobs/333")]))
def sitemap_urls(spark, sf_dir):
    return one_case(spark, sf_dir, [(X.SITEMAP,)], "xml string").select("page_id", F.posexplode(C.sitemap_urls("xml")).alias("pos", "url")).select("page_id", F.col("pos").cast("long").alias("pos"), "url")


@query(all_cases_sql("board_url, sitemap, n_jobs", [("https://a.orchard.fr/careers", "https://a.orchard.fr/sitemap.xml", 3), ("https://b.orchard.fr/careers", "https://b.orchard.fr/sm-jobs.xml", 3), ("https://c.orchard.fr/careers", "https://c.orchard.fr/maps/all.xml", 3)]).replace("SELECT page_id, ", "SELECT ", 1))
def sitemap_frontier(spark, sf_dir):
    """Four boards a page: sitemaps at the usual place, below an index, named by robots.txt, and one with too few postings."""
    fetches = ok(all_cases(spark, sf_dir, X.FETCHES, "url string, body string"))
    own = all_cases(spark, sf_dir, [(f"https://{h}.orchard.fr/careers",) for h in "abcd"], "board_url string")
    return C.find_sitemaps(own, fetches).select("board_url", "sitemap", F.size("jobs").cast("long").alias("n_jobs"))


SITEMAP_JOBS = 203


@query(f"""SELECT 'https://' || own || '.fr/jobs/' || (500100 + i) || '-deck-hand' AS url, CASE WHEN i = 1 THEN 'Ship Cook' ELSE 'Deck Hand' END AS title, CASE WHEN i = 1 THEN 'Bergen' END AS place
    FROM ({OWNED_SQL}) CROSS JOIN (SELECT unnest(range(1, {SITEMAP_JOBS + 1})) AS i)""")
def sitemap_details(spark, sf_dir):
    """The first 200 postings of a sitemap read their pages; later ones, fetched or not, take the title of their URL."""
    rows = owned(spark, sf_dir)
    job = lambda i: F.concat(F.lit("https://"), F.col("own"), F.lit(".fr/jobs/"), (i + 500100).cast("string"), F.lit("-deck-hand"))
    listed = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(SITEMAP_JOBS)), lambda i: F.concat(F.lit("<loc>"), job(i), F.lit("</loc>"))), "")
    pages = F.array(
        F.struct(F.concat(F.lit("https://"), F.col("own"), F.lit(".fr/sitemap.xml")).alias("url"), listed.alias("body")),
        F.struct(job(F.lit(1)).alias("url"), F.lit(X.JSONLD_PAGE).alias("body")), F.struct(job(F.lit(202)).alias("url"), F.lit(X.JSONLD_PAGE).alias("body")),
    )
    fetches = ok(rows.select(F.inline(pages)))
    own = rows.select(F.concat(F.lit("https://"), F.col("own"), F.lit(".fr/careers")).alias("board_url"), F.col("own").alias("company"))
    return C.sitemap_postings(own, fetches).select("url", "title", "place")


@query(one_case_sql("url, via, title, description, place", [(x[0], *x[2:]) for x in X.DETAIL_PAGES]).replace("SELECT page_id, ", "SELECT ", 1))
def detail_ladder(spark, sf_dir):
    cases = one_case(spark, sf_dir, [x[:2] for x in X.DETAIL_PAGES], "url string, body string")
    rows = cases.select(F.lit("Row company").alias("company"), F.lit("Row title").alias("title"), "url", F.lit("Row place").alias("place"), F.lit("none").alias("ats"))
    return details.read_details(rows, ok(cases.where("body is not null"))).select("url", "via", "title", "description", "place")


@query(one_case_sql("board_url, title, url, place, via", [("https://orchard.njoyn.com/x/", "Buyer", "https://orchard.njoyn.com/x/xweb.asp?Page=JobDetails&Jobid=J1", "Paris", "njoyn")]).replace("SELECT page_id, ", "SELECT own AS company, ", 1))
def html_tables(spark, sf_dir):
    return C.njoyn_postings(boards(one_case(spark, sf_dir, [("https://orchard.njoyn.com/x/", "njoyn", X.NJOYN_PAGE)], "board_url string, ats string, html string"), "html"))


@query(all_cases_sql("title, url", [("Ship Cook", "https://orchard.fr/jobs/41-ship-cook"), ("Deck Hand H/F", "https://orchard.fr/jobs/42-deck-hand"), ("43 Second Mate", "https://orchard.fr/jobs/43-second-mate")]).replace("SELECT page_id, ", "SELECT ", 1))
def board_links(spark, sf_dir):
    return C.link_postings(boards(one_case(spark, sf_dir, [("https://orchard.fr/careers", None, X.ANCHORS_PAGE)], "board_url string, ats string, html string"), "html")).select("title", "url")


@query(f"SELECT 'Job ' || i AS title, 'https://' || own || '.wd3.myworkdayjobs.com/en-US/careers/job/' || i AS url, 'Lyon' AS place FROM ({OWNED_SQL}) CROSS JOIN (SELECT unnest(range(45)) AS i)")
def workday_feed(spark, sf_dir):
    """Pages of 20 by POST, up to the first short one; what lies beyond it does not count."""
    page = lambda titles: json.dumps({"total": 45, "jobPostings": [{"title": t, "externalPath": f"/job/{t.split()[-1]}", "locationsText": " Lyon "} for t in titles]})
    at = "https://orchard.wd3.myworkdayjobs.com/wday/cxs/orchard/careers/jobs"
    fetches = all_cases(spark, sf_dir, [(at, "POST", json.dumps({"offset": o}), 200, page(t)) for o, t in X.WORKDAY_PAGES], "url string, method string, request_body string, status int, body string")
    own = one_case(spark, sf_dir, [("https://orchard.wd3.myworkdayjobs.com/en-US/careers/", "workday")], "board_url string, ats string")
    return C.workday_postings(boards(own), fetches).select("title", "url", "place")


@query(one_case_sql("title, url, place", [("Dev", "https://orchard/1", "Tel Aviv")]).replace("SELECT page_id, ", "SELECT ", 1))
def comeet_feed(spark, sf_dir):
    """Company id and token come from the page."""
    rows = owned(spark, sf_dir)
    uid = F.concat(F.col("page_id").cast("string"), F.lit(".005"))
    html = F.concat(F.lit('<script>{"company_uid": "'), uid, F.lit('", "token": "0123456789ABCDEF0"}</script>'))
    own = rows.select(F.concat(F.lit("https://www.comeet.co/jobs/"), F.col("own")).alias("board_url"), F.col("own").alias("company"), F.lit("comeet").alias("ats"), html.alias("html"))
    body = json.dumps([{"name": "Dev", "url_comeet_hosted_page": "https://orchard/1", "location": {"name": "Tel Aviv, Israel", "city": "Tel Aviv"}}, {"name": "No url"}])
    request = F.concat(F.lit("https://www.comeet.co/careers-api/2.0/company/"), uid, F.lit("/positions?token=0123456789ABCDEF0"))
    fetches = rows.select(request.alias("url"), F.lit(200).alias("status"), F.replace(F.lit(body), F.lit("orchard"), F.col("own")).alias("body"))
    return C.comeet_postings(own, fetches).select("title", "url", "place")


@query(one_case_sql("board_url, title, url", [("https://orchard.fr/carrieres", "Go developer – Team", "https://orchard.fr/offres/go")]).replace("SELECT page_id, ", "SELECT ", 1))
def wordpress_feed(spark, sf_dir):
    """Boards with marks of WordPress in their page; those without ask nothing."""
    own = all_cases(spark, sf_dir, [("https://orchard.fr/carrieres", None, "<link href='/wp-content/x.css'>"), ("https://b.orchard.fr/", None, "<p>plain</p>")], "board_url string, ats string, html string")
    posts = json.dumps([{"title": {"rendered": "Go developer &#8211; Team"}, "link": "https://orchard.fr/offres/go"}, {"title": {"rendered": ""}, "link": "https://orchard.fr/offres/x"}])
    answers = [("https://orchard.fr/wp-json/wp/v2/types", json.dumps({"post": {}, "offres": {}})), ("https://orchard.fr/wp-json/wp/v2/offres?per_page=100&page=1", posts)]
    return C.wordpress_postings(boards(own, "html"), ok(all_cases(spark, sf_dir, answers, "url string, body string"))).select("board_url", "title", "url")


@query(one_case_sql("ats, reader, endpoint", X.READERS))
def vendor_notes(spark, sf_dir):
    """How postings of the page's platform are read, or that nothing of its own reads them."""
    wanted = one_case(spark, sf_dir, [x[:1] for x in X.READERS], "ats string")
    notes = spark.createDataFrame(platform_readers(), "ats string, reader string, endpoint string")
    return wanted.join(F.broadcast(notes), "ats").select("page_id", "ats", "reader", "endpoint")


# --- detection -------------------------------------------------------------------------

PLATFORMS = len(X.PLATFORM_PAGES)


def platform_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_case(spark, sf_dir, [x[1:3] for x in X.PLATFORM_PAGES], "url string, html string")


@query(results_sql("signal_id, points", [(0, "lever.hostname", 60), (2, "phenom.script_src", 45), (2, "phenom.link_href", 40), (4, "breezy.hostname", 60), (4, "bamboohr.iframe_src", 45), (5, "teamtailor.canonical", 50), (5, "recruitee.canonical", 50)], PLATFORMS))
def url_signals(spark, sf_dir):
    fired = D.fired_rules(D.extract_signals(platform_pages(spark, sf_dir)))
    return fired.where("source in ('hostname', 'script_src', 'canonical', 'iframe_src', 'link_href')").select("page_id", "signal_id", F.col("points").cast("long").alias("points"))


@query(one_case_sql("detected_ats, status", [x[3:] for x in X.PLATFORM_PAGES]))
def detect_fixtures(spark, sf_dir):
    return D.detect(platform_pages(spark, sf_dir)).select("page_id", "detected_ats", "status")


@query(one_case_sql("needs_rendering, unknown_vendor", [(False, None)] * 6 + [(True, "vendorx.io")]))
def unknown_vendor(spark, sf_dir):
    return D.detect(platform_pages(spark, sf_dir)).select("page_id", "needs_rendering", "unknown_vendor")


@query(results_sql("pos, signal_id, points", [(0, 0, "lever.hostname", 60), (0, 1, "lever.posting_uuid", 40), (1, 0, "greenhouse.gh_jid", 60), (2, 0, "phenom.script_src", 45), (2, 1, "phenom.link_href", 40), (3, 0, "workday.text", 2), (4, 0, "breezy.hostname", 60), (4, 1, "bamboohr.iframe_src", 45), (4, 2, "breezy.position_path", 45), (5, 0, "teamtailor.canonical", 50), (5, 1, "recruitee.canonical", 50)], PLATFORMS))
def evidence_order(spark, sf_dir):
    rows = D.evidence_list(D.capped_points(D.fired_rules(D.extract_signals(platform_pages(spark, sf_dir)))))
    return rows.select("page_id", F.posexplode("evidence").alias("pos", "e")).select("page_id", F.col("pos").cast("long").alias("pos"), "e.signal_id", "e.points")


LINES = ["lever: detected (score 100, confidence 0.9)", "greenhouse: detected (score 60, confidence 0.8)", "phenom: detected (score 85, confidence 0.74)", "unknown (score 2, confidence 0.107)", "breezy: detected (score 100, confidence 0.765)", "ambiguous between teamtailor and recruitee (score 50, confidence 0.267)", "unknown (score 0, confidence 0.0), looks unrendered, maybe vendorx.io"]


@query(one_case_sql("line", [(x,) for x in LINES]))
def result_lines(spark, sf_dir):
    """Verdicts as lines for a console."""
    return D.detect(platform_pages(spark, sf_dir)).select("page_id", D.result_line().alias("line"))


@query(results_sql("signal_id, points, matched", [(i, *r) for i, x in enumerate(X.RULE_PAGES) for r in x[3]], len(X.RULE_PAGES)))
def single_rules(spark, sf_dir):
    """What fires on pages made for one kind of rule each, and on pages where nothing may."""
    pages = one_case(spark, sf_dir, [x[1:3] for x in X.RULE_PAGES], "url string, html string")
    return D.fired_rules(D.extract_signals(pages)).select("page_id", "signal_id", F.col("points").cast("long").alias("points"), "matched")


@query(one_case_sql("signal_id, length", [("lever.jsonld", 160), ("breezy.meta", 120)]))
def evidence_previews(spark, sf_dir):
    """Long matches are cut for display."""
    cases = ['<script type="application/ld+json">["https://jobs.lever.co/' + "x" * 400 + '"]</script>', '<meta name="generator" content="breezy hr ' + "y" * 400 + '">']
    pages = one_case(spark, sf_dir, [("https://work.orchard.example/", c) for c in cases], "url string, html string")
    return D.fired_rules(D.extract_signals(pages)).select("page_id", "signal_id", F.length("matched").cast("long").alias("length"))


@query("SELECT page_id, CAST(least(480 + page_id % 40, 500) AS BIGINT) AS anchors, CAST(480 + page_id % 40 AS BIGINT) AS ids FROM pages")
def signal_caps(spark, sf_dir):
    """At most 500 anchors count; ids of all 20,000 first elements do."""
    link = F.transform(F.sequence(F.lit(1).cast("long"), 480 + F.col("page_id") % 40), lambda i: F.format_string('<a id="i%d" href="/%d"></a>', i, i))
    pages = owned(spark, sf_dir).select("page_id", F.col("page_url").alias("url"), F.array_join(link, "").alias("html"))
    return D.extract_signals(pages).select("page_id", F.size("anchor_urls").cast("long").alias("anchors"), F.size("ids").cast("long").alias("ids"))


@query(one_case_sql("status, ats", [("detected", "lever"), ("unknown", None), ("detected", "workday")]))
def rendered_again(spark, sf_dir):
    """Verdicts of rendered pages count unless they are still unknown."""
    first = one_case(spark, sf_dir, [("unknown", None), ("unknown", None), ("detected", "workday")], "status string, ats string").drop("own")
    again = one_case(spark, sf_dir, [("detected", "lever"), ("unknown", "x"), (None, None)], "status string, ats string").drop("own").where("status is not null")
    return D.with_rendered(first, again)


@query(f"SELECT DISTINCT page_id, domain FROM pages JOIN (VALUES {', '.join(f'({i}, {chr(39)}{d}{chr(39)})' for i, a in enumerate(ATS) for d in sorted({*a.hosts, *a.assets}))}) AS t(nth, domain) ON page_id % {len(ATS)} = nth")
def domain_union(spark, sf_dir):
    """Hosts and asset domains of the page's platform, each once."""
    wanted = one_case(spark, sf_dir, [(a.name,) for a in ATS], "ats string")
    return wanted.join(F.broadcast(D.domains_table(spark)), "ats").select("page_id", "domain").distinct()


@query(one_case_sql("label", [(x[3],) for x in X.LABELLED]))
def ground_truth(spark, sf_dir):
    rows = one_case(spark, sf_dir, [x[:3] for x in X.LABELLED], "page string, html string, fallback string")
    return rows.select("page_id", D.ground_truth("page", "html", "fallback").alias("label"))


SCORED = [(0, "a", 0, 90, 3, 1, 3, False), (0, "b", 1, 20, 1, 0, 1, False), (1, "a", 0, 50, 1, 0, 1, False), (2, "a", 0, 60, 2, 1, 1, False), (2, "b", 1, 55, 1, 0, 1, False), (3, "b", 1, 60, 1, 1, 1, True), (3, "a", 0, 90, 2, 1, 2, False)]


@query(one_case_sql("status, winner, score, runner_up, second_score, confidence", [("detected", "a", 90, "b", 20, 0.933), ("unknown", "a", 50, None, 0, 0.187), ("ambiguous", "a", 60, "b", 55, 0.333), ("detected", "b", 60, "a", 90, 0.35)]))
def verdict(spark, sf_dir):
    scored = all_cases(spark, sf_dir, SCORED, "at long, ats string, ats_idx int, score long, sources long, tier1 long, tier2 long, has_host boolean").where("page_id % 4 = at").drop("own", "at")
    return D.verdicts(scored).select("page_id", "status", "winner", "score", "runner_up", "second_score", "confidence")


# --- documents ----------------------------------------------------------------------------


@query(all_cases_sql("token, pos, bold, rest, ends_entry", X.CV_LINES))
def cv_sections(spark, sf_dir):
    cvs = one_case(spark, sf_dir, [(json.dumps(X.CV),)], "cv string").select(F.col("page_id").alias("id"), "cv")
    return documents.cv_lines(cvs).select(F.col("id").alias("page_id"), "token", F.col("pos").cast("long").alias("pos"), "bold", "rest", "ends_entry")


@query(one_case_sql("locale, text", [("fr", "COMPÉTENCES: Français! orchard"), ("de", "SKILLS: French! orchard"), ("en", "SKILLS: French! orchard")]))
def l10n_lookup(spark, sf_dir):
    l10n = spark.createDataFrame(X.L10N, "locale string, key string, value string")
    rows = one_case(spark, sf_dir, [("fr",), ("de",), ("en",)], "locale string")
    text = documents.resolved(F.concat(F.lit("{SKILLS_TITLE}: {language_fr}! "), F.col("own")), F.col("strings"))
    return documents.with_locale(rows, l10n).select("page_id", "locale", text.alias("text"))


@query(one_case_sql("text, slug", X.SLUGS))
def ascii_slug(spark, sf_dir):
    return one_case(spark, sf_dir, X.SLUGS, "text string, expected string").select("page_id", "text", J.ascii_slug("text").alias("slug"))


@query(one_case_sql("text, name", [(t, "_".join(x for x in ("Ann_Lee", s, "Dev") if x) + ".docx") for t, s in X.SLUGS]))
def document_filename(spark, sf_dir):
    rows = one_case(spark, sf_dir, X.SLUGS, "text string, expected string")
    return rows.select("page_id", "text", documents.filename(F.lit("Ann Lee"), F.col("text"), F.lit("Dev")).alias("name"))


@query(all_cases_sql("case, rejected", [(x[0], x[4]) for x in X.ANALYSES_IN]).replace("t.case AS case", 'page_id * 10 + t."case" AS id').replace("SELECT page_id, ", "SELECT ", 1).replace("(case, rejected)", '("case", rejected)'))
def write_validation(spark, sf_dir):
    """Each page has two known postings, of which one is graded, and seven incoming grades."""
    cases = all_cases(spark, sf_dir, [x[:4] for x in X.ANALYSES_IN], "n long, adequation_grade int, depth_analysis string, job long")
    at = lambda n: F.col("page_id") * 100 + n
    incoming = cases.select((F.col("page_id") * 10 + F.col("n")).alias("id"), "adequation_grade", "depth_analysis", at(F.col("job")).alias("job_id"))
    pages = owned(spark, sf_dir)
    known, have = pages.select(F.explode(F.array(at(F.lit(1)), at(F.lit(2)))).alias("id")), pages.select(at(F.lit(2)).alias("job_id"))
    return store.check_analyses(incoming, known, have).select("id", "rejected")


PARAGRAPHS = [(["  ", "Ann orchard 🚀", "Cook"], "Ann orchard 🚀"), ([], "CV"), (["\t", " orchard "], "orchard")]


@query(one_case_sql("name", [(x[1],) for x in PARAGRAPHS]))
def candidate_names(spark, sf_dir):
    rows = one_case(spark, sf_dir, [x[:1] for x in PARAGRAPHS], "paragraphs array<string>")
    return rows.select("page_id", documents.candidate_name(F.col("paragraphs")).alias("name"))


OUTPUTS = [('{"adequation_grade": 70, "depth_analysis": "fits orchard"}', 70), ('{"adequation_grade": 101, "depth_analysis": "x"}', None), ('{"adequation_grade": 5, "depth_analysis": ""}', None), ("no json", None), (None, None)]


@query(one_case_sql("grade", [(x[1],) for x in OUTPUTS]))
def model_outputs(spark, sf_dir):
    """Grades of outputs that follow the schema."""
    rows = one_case(spark, sf_dir, [x[:1] for x in OUTPUTS], "output string")
    return documents.parse_verdicts(rows).select("page_id", F.col("verdict.adequation_grade").cast("long").alias("grade"))


@query(one_case_sql("missing", [(len(documents.TOKENS),), (len(documents.TOKENS) - 1,), (0,)]))
def template_gaps(spark, sf_dir):
    """How many content tokens templates lack."""
    rows = one_case(spark, sf_dir, [([],), ([documents.TOKENS[0], "OTHER"],), (list(documents.TOKENS),)], "tokens array<string>")
    return rows.select("page_id", F.size(documents.missing_tokens(F.col("tokens"))).cast("long").alias("missing"))
