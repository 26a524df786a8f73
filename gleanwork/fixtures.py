"""Small inline inputs and their known results, for queries that the test tables cannot feed."""

from __future__ import annotations

import json

TITLES = [
    ("https://orchard.example/fr/emplois/ingenieur-qualite/55120", "Ingenieur Qualite"),
    ("https://orchard.example/offres/7zk2mm9qp4-chargee-de-paie-h-f/", "Chargee De Paie H F"),
    ("https://orchard.example/nl/jobs/planner-%7C-haven/30412", "Planner | Haven"),
    ("https://orchard.example/jobs/ma%C3%AEtre-nageur/118", "Maître Nageur"),
    ("https://orchard.example/jobs/junior-rust-engineer.html", "Junior Rust Engineer"),
    ("https://orchard.example/jobs/night-auditor", "Night Auditor"),
    ("https://orchard.example/pastry-chef", "Pastry Chef"),
    ("https://orchard.example/careers/site_supervisor_m_w", "Site Supervisor M W"),
    ("https://orchard.example/jobs/509177-acheteur-textile", "Acheteur Textile"),
    ("https://orchard.example/jobs/principal_tax_lawyer/", "Principal Tax Lawyer"),
    ("https://orchard.example/carrieres/soudeur-tig.html", "Soudeur Tig"),
    ("https://orchard.example/jobs/agent-de-quai.aspx", "Agent De Quai"),
    ("https://orchard.example/jobs/90210", ""),
    ("https://orchard.example/job/7", ""),
    ("https://orchard.example/", ""),
    ("https://orchard.example", ""),
]
POSTING_PATHS = [
    ("/orchard/jobs/5512-regisseur-son", True), ("/orchard/emplois/plombier-chauffagiste", True), ("/orchard/offre-emploi/88-monteur-cable", True), ("/orchard/offres-demploi/juriste-social", True),
    ("/orchard/offres-d-emploi/gardien-de-nuit", True), ("/orchard/nos-offres/libraire-jeunesse", True), ("/orchard/de/nos-offres-emploi/31-9-2-controleur", True),
    ("/orchard/fr/espace/carrieres/technicien-froid-h-f", True), ("/orchard/fr/espace/carrieres/91b7c0aa-12f3-4c55-9e0d-7a6b5c4d3e2f", True),
    ("/orchard/career-paths/ten-tips", False), ("/orchard/jobs-newsletter/spring", False), ("/orchard/offres-demploi/", False), ("/orchard/press/kit", False),
    ("/orchard/emplois/", False), ("/orchard/carrieres/", False), ("/orchard/nos-offres/", False),
]
SHAPED = [
    ("teamtailor", "https://orchard.example/jobs/440-baker", True), ("teamtailor", "https://orchard.example/jobs/baker", False), ("icims", "https://orchard.example/jobs/31/baker/job", True),
    ("breezy", "https://orchard.example/p/7c1d", True), ("bamboohr", "https://orchard.example/careers/52", True), ("personio", "https://orchard.example/job/901", True), ("personio", "https://orchard.example/press", False),
    ("pinpoint", "https://orchard.example/jobs/63/", True), ("pinpoint", "https://orchard.example/jobs/63?ref=mail", False), ("radancy", "https://orchard.example/job/oslo/baker/71/804", True), ("radancy", "https://orchard.example/job/oslo/baker/71/all", False),
    ("njoyn", "https://orchard.example/cl/xweb/xweb.asp?clid=9&Page=JobDetails&Jobid=B-3", True), ("njoyn", "https://orchard.example/cl/xweb/xweb.asp?Page=Search", False),
]
HOSTS = [
    ("https://lumen.jobs.personio.de/", "personio"), ("https://orchard.breezy.hr/", "breezy"), ("https://orchard.wd12.myworkdayjobs.com/open", "workday"),
    ("https://orchard.applytojob.com/", "jazzhr"), ("https://work.orchard.example/jobs", None), ("https://www.mybreezy.hr.example/", None), ("https://boards.greenhouse.io/orchard", "greenhouse"),
]
REASONS = [
    ("no job-shaped links (14 anchors, 3 scripts)", "no job-shaped links", 14.0, 3.0, None, None),
    ('likely javascript-rendered (2 anchors, 40 scripts, id="root")', "likely javascript-rendered", 2.0, 40.0, 'id="root"', None),
    ("no links on the page (0 anchors, 7 scripts) (redirected to https://orchard.example/login?next=%2F)", "no links on the page", 0.0, 7.0, None, "https://orchard.example/login?next=%2F"),
    ("fetch failed: ReadTimeout", "fetch failed: ReadTimeout", None, None, None, None),
]
TOKENS = [
    ("greenhouse", "https://boards.greenhouse.io/orchard", "orchard"), ("greenhouse", "https://boards.greenhouse.io/embed/job_board?for=lumen&b=1", "lumen"),
    ("lever", "https://jobs.lever.co/orchard/", "orchard"), ("ashby", "https://jobs.ashbyhq.com/lumen?locationId=2", "lumen"),
    ("recruitee", "https://lumen.recruitee.com", "lumen"), ("workable", "https://apply.workable.com/harbour-co/", "harbour-co"),
]
FIRST_STRINGS = [
    (json.dumps({"x": " ", "y": "", "z": "Oslo"}), "", "Oslo"), ("[]", "", None), (json.dumps({"site": {"town": "orchard"}}), "site.town", "orchard"), (json.dumps({"site": [{"town": "orchard"}]}), "site.town", "orchard"),
    (json.dumps({"site": {}}), "site.town.zip", None), (json.dumps({"site": "plain"}), "site.town", None), (json.dumps("orchard"), "", "orchard"), (json.dumps({"label": "orchard"}), "", "orchard"),
    (json.dumps([{"town": "Malmö"}]), "", "Malmö"), ("{broken", "", None), (json.dumps({"floor": 12}), "", None),
]
WORKDAY_URLS = [
    ("https://orchard.wd12.myworkdayjobs.com/en-GB/open/job/Oslo/Baker_R-77", "https://orchard.wd12.myworkdayjobs.com/wday/cxs/orchard/open/job/Oslo/Baker_R-77"),
    ("https://orchard.wd12.myworkdayjobs.com/open", "https://orchard.wd12.myworkdayjobs.com/wday/cxs/orchard/open"),
    ("https://orchard.wd12.myworkdayjobs.com/", None),
]
JOINS = [
    ("https://orchard.com/a/b?q=1", "c", "https://orchard.com/a/c"), ("https://orchard.com/a/b", "/c", "https://orchard.com/c"), ("https://orchard.com/a/b", "//y.com/c", "https://y.com/c"),
    ("https://orchard.com/a/b", "?p=2", "https://orchard.com/a/b?p=2"), ("https://orchard.com/a/b", "#f", "https://orchard.com/a/b#f"), ("https://orchard.com/a/", "../c", "https://orchard.com/c"), ("https://orchard.com/a", "http://z.com/", "http://z.com/"),
]
SLUGS = [("Møbel & Træ orchard", "Mbel_Tr_orchard"), ("Crème brûlée - orchard", "Creme_brulee_orchard"), ("", ""), ("東京", "")]
XML = "<jobs><job><title>Bake &amp; Serve</title><city> Oslo </city><url>https://orchard/1</url></job><job><title><![CDATA[Cook <2>]]></title><url>https://orchard/2</url></job></jobs>"
SITEMAP = "".join(f"<url><loc> {u} </loc></url>" for u in ("https://orchard.fr/jobs/1-dev", "https://orchard.fr/about", "https://orchard.fr/jobs/2-ops", "https://orchard.fr/jobs/1-dev", "https://orchard.fr/jobs/333"))
FETCHES = [
    ("https://a.orchard.fr/sitemap.xml", SITEMAP),
    ("https://b.orchard.fr/sitemap_index.xml", "<loc>https://b.orchard.fr/sm-jobs.xml</loc><loc>https://b.orchard.fr/sm-stores.xml</loc>"),
    ("https://b.orchard.fr/sm-jobs.xml", SITEMAP),
    ("https://c.orchard.fr/robots.txt", "User-agent: *\nSitemap: https://c.orchard.fr/maps/all.xml\n"),
    ("https://c.orchard.fr/maps/all.xml", SITEMAP),
    ("https://d.orchard.fr/sitemap.xml", "<loc>https://d.orchard.fr/jobs/1-dev</loc>"),
]
JSONLD_PAGE = (
    '<html><head><script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"Ship Cook","description":"&lt;p&gt;Fish &amp;amp; bread&lt;/p&gt;",'
    '"hiringOrganization":{"name":"orchard Line"},"jobLocation":[{"address":{"addressLocality":"Bergen"}}]}]}</script></head><body><nav>Menu</nav><h1>Other</h1></body></html>'
)
DETAIL_PAGES = [
    ("https://orchard/1", JSONLD_PAGE, "jsonld", "Ship Cook", "Fish & bread", "Bergen"),
    ("https://orchard/2", '<body><nav>Menu</nav><main><nav>x</nav>Missions.<footer>f</footer></main></body>', "main", "Row title", "Missions.", "Row place"),
    ("https://orchard/3", '<head><meta property="og:title" content="Og"></head><body><h1>H</h1><div role="main">Text</div></body>', "main", "Og", "Text", "Row place"),
    ("https://orchard/4", "<body><header>Top</header><h1>Head</h1><p>Body text</p><script>x()</script></body>", "body", "Head", "Head\nBody text", "Row place"),
    ("https://orchard/5", None, "none", "Row title", "", "Row place"),
]
NJOYN_PAGE = (
    "<table><tr><td>layout</td></tr></table><table><tr><th>Job ID</th><th>City</th><th>Title</th></tr>"
    '<tr><td><a href="xweb.asp?Page=JobDetails&Jobid=J1">J1</a></td><td>Paris</td><td>Buyer</td></tr><tr><td>none</td><td>Rome</td><td>No link</td></tr></table>'
)
ANCHORS_PAGE = (
    '<div class="card"><h3>Ship Cook</h3><a href="/jobs/41-ship-cook">Lire la suite</a></div><a href="/jobs/42-deck-hand">Deck Hand H/F</a><a href="#top">Top of page</a>'
    '<a href="/about">About us</a><p><a href="/jobs/43-second-mate"> &gt; </a></p>'
)
PLATFORM_PAGES = [
    (1, "https://jobs.lever.co/orchard/5e4d3c2b-9999-8888-7777-666655554444", "<p>x</p>", "lever", "detected"),
    (2, "https://work.orchard.example/?gh_jid=88012", "<p>x</p>", "greenhouse", "detected"),
    (3, "https://work.orchard.example/jobs", '<script src="https://cdn.phenompeople.com/a.js"></script><link href="https://assets.phenompeople.com/b.css" rel="stylesheet">', "phenom", "detected"),
    (4, "https://work.orchard.example/", "<p>powered by nothing, but workday is mentioned</p>", None, "unknown"),
    (5, "https://orchard.breezy.hr/p/7c1d", '<iframe src="https://x.bamboohr.com/y"></iframe>', "breezy", "detected"),
    (6, "https://work.orchard.example/x", '<link rel="canonical" href="https://orchard.teamtailor.com/jobs"><link rel="alternate" href="https://orchard.recruitee.com/">', None, "ambiguous"),
    (7, "https://work.orchard.example/y", '<script src="https://static.vendorx.io/a.js"></script><script src="https://cdn.vendorx.io/b.js"></script><div id="root"></div>', None, "unknown"),
]
CV = {
    "cv_introduction": "Twelve years at sea", "profile_text": "Calm in storms",
    "skills": [{"competence": "Deck", "skills": ["Knots", "Charts", "Radar"]}, {"competence": "Radio", "skills": ["Morse"]}],
    "experiences": [
        {"role": "Second Mate", "company": "Harbour Line", "location": "Bergen, Norway", "start_date": "May, 2019", "end_date": "June, 2023", "bullets": ["Kept watch"]},
        {"role": "Deckhand", "company": "orchard Ferries", "location": "Turku, Finland", "start_date": "March, 2016", "end_date": "May, 2019", "bullets": ["Moored", "Painted"]},
    ],
    "education": [
        {"diploma": "Mate licence", "institution": "Sea School", "location": "Oslo", "period": "2015", "degree": "Navigation", "details": " "},
        {"diploma": "Radio licence", "institution": "Coast College", "location": "Malmö", "period": "2014", "degree": "Signals", "details": "Night classes"},
    ],
}
CV_LINES = [
    ("CV_INTRODUCTION", 0, "", "Twelve years at sea", True), ("PROFILE_TEXT", 0, "", "Calm in storms", True), ("SKILLS_LIST_TEXT", 0, "Deck: ", "Knots, Charts, Radar", True), ("SKILLS_LIST_TEXT", 1, "Radio: ", "Morse", True),
    ("EXPERIENCES_PLACEHOLDER", 0, "Second Mate - Harbour Line", ", Bergen, Norway (May, 2019 - June, 2023)", False), ("EXPERIENCES_PLACEHOLDER", 1, "", "• Kept watch", True),
    ("EXPERIENCES_PLACEHOLDER", 2, "Deckhand - orchard Ferries", ", Turku, Finland (March, 2016 - May, 2019)", False), ("EXPERIENCES_PLACEHOLDER", 3, "", "• Moored", False), ("EXPERIENCES_PLACEHOLDER", 4, "", "• Painted", True),
    ("EDUCATION_PLACEHOLDER", 0, "Mate licence - Sea School", ", Oslo (2015)", False), ("EDUCATION_PLACEHOLDER", 1, "", "Navigation", True),
    ("EDUCATION_PLACEHOLDER", 2, "Radio licence - Coast College", ", Malmö (2014)", False), ("EDUCATION_PLACEHOLDER", 3, "", "Signals", False), ("EDUCATION_PLACEHOLDER", 4, "", "Night classes", True),
]
L10N = [("en", "SKILLS_TITLE", "SKILLS"), ("en", "language_fr", "French"), ("fr", "SKILLS_TITLE", "COMPÉTENCES"), ("fr", "language_fr", "Français")]
ANALYSES_IN = [(1, 101, "x", 1, "grade out of range"), (2, -1, "x", 1, "grade out of range"), (3, 50, "  ", 1, "blank analysis"), (4, 50, "x", 99, "unknown job"), (5, 50, "x", 2, "already graded"), (6, 50, " ok ", 1, None), (7, 60, "again", 1, "already graded")]

LABELLED = [
    ("https://x.wd3.myworkdayjobs.com/a", "", None, "workday"), ("https://work.orchard.example/", "<script src='https://cdn.phenompeople.com/x.js'>", None, "phenom"),
    ("https://work.orchard.example/", "app.ashbyhq.com and cdn.lever.co", "generic", "generic"), ("https://work.orchard.example/", "", "generic", "generic"),
]
#: Pages for single rules: page, URL, HTML, and what must fire: (signal, points, matched).
RULE_PAGES = [
    (21, "https://work.orchard.example/a", "".join(f'<a href="https://{u}">go</a>' for u in ("a.icims.com/1", "b.icims.com/2", "a.icims.com/1", "z.jazz.co/9", "c.jazz.co/5", "m.jazz.co/7", "a.jazz.co/1")), [("jazzhr.anchor", 35, "https://c.jazz.co/5")]),
    (22, "https://work.orchard.example/b", r'<script>var u = ["https:\/\/q.avature.net\/3", "https:\/\/p.avature.net\/1", "https:\/\/r.avature.net\/2"]</script>', [("avature.script_url", 35, "https://p.avature.net/1")]),
    (23, "https://work.orchard.example/c", '<script>Window.Recruitee = {}</script><a href="/x?gh_jid=5">y</a><p>Powered by iCIMS</p>', [("recruitee.js_global", 40, "window.recruitee"), ("greenhouse.gh_jid_embed", 25, "gh_jid="), ("icims.footer", 35, "powered by icims"), ("icims.text", 2, "icims")]),
    (24, "https://work.orchard.example/d", '<script src="/lib/CareerSite/public/iframe.js"></script><script src="https://cdn.orchard.example/jazz.co/widgets/buttons/create/9"></script>', [("jobvite.iframe_js", 45, "https://work.orchard.example/lib/CareerSite/public/iframe.js"), ("jazzhr.widget", 40, "https://cdn.orchard.example/jazz.co/widgets/buttons/create/9")]),
    (25, "https://work.orchard.example/e", '<div id="Personio-Iframe" class="wide js-careers-jobs-block"></div><b class="JV-Careersite">x</b>', [("personio.iframe", 40, "personio-iframe"), ("pinpoint.jobs_block", 35, "js-careers-jobs-block"), ("jobvite.careersite_class", 40, "jv-careersite")]),
    (26, "https://work.orchard.example/f", '<div data-careersite="q" data-automation-id="jobPostingHeader"></div><i data-automation-id="other"></i>', [("jobvite.careersite_attr", 40, "data-careersite"), ("workday.automation_id", 30, "data-automation-id=jobpostingheader")]),
    (27, "https://work.orchard.example/g", '<meta name="Generator" content="Breezy HR portal"><meta name="author" content="me">', [("breezy.meta", 2, "generator=Breezy HR portal")]),
    (28, "https://work.orchard.example/h", '<script type="application/ld+json">{"@type": "Thing", "sameAs": ["no link", "https://jobs.lever.co/orchard"]}</script>', [("lever.jsonld", 25, "https://jobs.lever.co/orchard")]),
    (29, "https://work.orchard.example/i", "<p>Made with Cegid Talent.</p>", [("talentsoft.text", 2, "cegid talent")]),
    (30, "https://work.orchard.example/j", '<form action="https://orchard.talentlyft.com/apply"></form>', [("talentlyft.form_action", 45, "https://orchard.talentlyft.com/apply")]),
    (31, "https://work.orchard.example/jobs/77/deck/job", "<p>x</p>", []),
    (32, "https://careers-orchard.icims.com/jobs/77/deck/job", "<p>x</p>", [("icims.hostname", 60, "careers-orchard.icims.com"), ("icims.job_path", 45, "/jobs/77/deck/job")]),
    (33, "https://work.orchard.example/careersection/2", "<p>x</p>", [("taleo.careersection", 55, "/careersection/")]),
    (34, "https://work.orchard.example/k", "<script>// talentlyft in a script is no text\n</script><!-- workday --><style>.taleo{}</style><p>x</p>", []),
]
#: One board of each feed: platform, board, request, body, and the posting it gives.
FEED_BOARDS = [
    ("greenhouse", "https://boards.greenhouse.io/orchard", "https://boards-api.greenhouse.io/v1/boards/orchard/jobs", '{"jobs": [{"title": " Cook ", "location": {"name": "Oslo"}, "absolute_url": "https://g.orchard/1"}]}', "Cook", "Oslo", "https://g.orchard/1"),
    ("lever", "https://jobs.lever.co/orchard", "https://api.lever.co/v0/postings/orchard?mode=json", '[{"text": "Mate", "categories": {"location": "Turku"}, "hostedUrl": "https://l.orchard/1"}]', "Mate", "Turku", "https://l.orchard/1"),
    ("ashby", "https://jobs.ashbyhq.com/orchard", "https://api.ashbyhq.com/posting-api/job-board/orchard", '{"jobs": [{"title": "Pilot", "location": "Bergen", "jobUrl": "https://a.orchard/1"}]}', "Pilot", "Bergen", "https://a.orchard/1"),
    ("recruitee", "https://orchard.recruitee.com/", "https://orchard.recruitee.com/api/offers/", '{"offers": [{"title": "Clerk", "location": "Riga", "careers_url": "https://r.orchard/1"}, {"title": "", "careers_url": "https://r.orchard/2"}]}', "Clerk", "Riga", "https://r.orchard/1"),
    ("workable", "https://apply.workable.com/orchard/", "https://apply.workable.com/api/v1/widget/accounts/orchard?details=true", '{"jobs": [{"title": "Baker", "city": "Gdansk", "url": "https://w.orchard/1"}]}', "Baker", "Gdansk", "https://w.orchard/1"),
    ("smartrecruiters", "https://careers.smartrecruiters.com/orchard", "https://api.smartrecruiters.com/v1/companies/orchard/postings?limit=100", '{"totalFound": 1, "content": [{"id": 9, "name": "Smith", "location": {"city": "Kiel"}}]}', "Smith", "Kiel", "https://jobs.smartrecruiters.com/orchard/9"),
    ("breezy", "https://orchard.breezy.hr/", "https://orchard.breezy.hr/json", '[{"name": "Tailor", "location": {"city": "Ghent", "name": "Ghent, BE"}, "url": "https://b.orchard/1"}]', "Tailor", "Ghent", "https://b.orchard/1"),
    ("bamboohr", "https://orchard.bamboohr.com/careers", "https://orchard.bamboohr.com/careers/list", '{"result": [{"id": "31", "jobOpeningName": "Miller", "atsLocation": {"city": "Lyon"}}]}', "Miller", "Lyon", "https://orchard.bamboohr.com/careers/31"),
    ("pinpoint", "https://orchard.pinpointhq.com/", "https://orchard.pinpointhq.com/postings.json", '{"data": [{"title": "Nurse", "location": {"city": "Cork"}, "url": "https://p.orchard/1"}]}', "Nurse", "Cork", "https://p.orchard/1"),
    ("personio", "https://orchard.jobs.personio.de/", "https://orchard.jobs.personio.de/xml", "<workzag-jobs><position><id>4</id><name>Potter &amp; Co</name><office>Ulm</office></position></workzag-jobs>", "Potter & Co", "Ulm", "https://orchard.jobs.personio.de/job/4"),
    ("jazzhr", "https://orchard.applytojob.com/", "https://app.jazz.co/feeds/export/jobs/orchard", "<jobs><job><title>Sailor</title><city>Porto</city><url>https://j.orchard/1</url></job></jobs>", "Sailor", "Porto", "https://j.orchard/1"),
]
WORKDAY_PAGES = [(0, [f"Job {i}" for i in range(20)]), (20, [f"Job {i}" for i in range(20, 40)]), (40, [f"Job {i}" for i in range(40, 45)]), (60, ["Beyond"])]


CONTENT_TYPES = [("text/html; x=orchard", True), ("TEXT/PLAIN; charset=x", True), ("application/json", True), ("application/xhtml+xml", True), ("image/png", False), ("application/pdf", False), ("", True), (None, True), ("application/octet-stream", False)]
READERS = [("workday", "connector", None), ("comeet", "connector", None), ("njoyn", "connector", None), ("lever", "feed", "https://api.lever.co/v0/postings/{token}?mode=json"), ("taleo", "links", None), ("hibob", "general", None), ("phenom", "general", None)]


def sql_value(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int):
        return f"CAST({x} AS BIGINT)"
    if isinstance(x, float):
        return f"CAST({x!r} AS DOUBLE)"
    return "'" + str(x).replace("'", "''") + "'"


def values_sql(names: str, rows: list[tuple]) -> str:
    """SQL of literal rows."""
    listed = ", ".join("(" + ", ".join(map(sql_value, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {listed}) AS t({names})"
