"""Platforms, their rules, feeds and posting shapes, as data."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Platform:
    name: str
    hosts: tuple[str, ...]
    assets: tuple[str, ...]
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Rule:
    """``kind`` says how ``what`` is looked for in ``source``; ``gated`` rules need a page on the vendor's host."""

    signal_id: str
    source: str
    points: int
    tier: int
    kind: str
    what: str
    value: str = ""
    gated: bool = False

    @property
    def ats(self) -> str:
        return self.signal_id.split(".")[0]


@dataclass(frozen=True)
class Feed:
    ats: str
    endpoint: str
    tokens: tuple[str, ...]
    items: str
    title: str
    place: str
    link: str = ""
    link_url: str = ""
    item_tag: str = ""
    total: str = ""
    param: str = ""


# --- fixed values: the platform registry, in tie-break order ---
ATS = (
    Platform("workday", ("myworkdayjobs.com",), ("myworkdayjobs.com", "workday.com"), ("workday",)),
    Platform("smartrecruiters", ("smartrecruiters.com",), ("smartrecruiters.com",), ("smartrecruiters",)),
    Platform("greenhouse", ("greenhouse.io",), ("greenhouse.io",), ("greenhouse",)),
    Platform("icims", ("icims.com",), ("icims.com",), ("icims",)),
    Platform("successfactors", ("jobs.hr.cloud.sap", "jobs.hr.sapcloud.cn"), ("jobs.hr.cloud.sap", "jobs.hr.sapcloud.cn", "successfactors.com", "successfactors.eu", "sapsf.com", "sapsf.eu", "sapsf.cn"), ("successfactors",)),
    Platform("taleo", ("taleo.net",), ("taleo.net",), ("taleo",)),
    Platform("lever", ("jobs.lever.co",), ("lever.co",), ("lever",)),
    Platform("teamtailor", ("teamtailor.com",), ("teamtailor-cdn.com", "teamtailor.com"), ("teamtailor",)),
    Platform("recruitee", ("recruitee.com",), ("recruitee.com",), ("recruitee",)),
    Platform("ashby", ("jobs.ashbyhq.com", "ashbyhq.com"), ("ashbyhq.com",), ("ashbyhq",)),
    Platform("workable", ("apply.workable.com", "workable.com"), ("workable.com",), ("workable",)),
    Platform("bamboohr", ("bamboohr.com",), ("bamboohr.com", "bamboohr.co.uk"), ("bamboohr",)),
    Platform("talentsoft", ("talentsoft.com", "cegid-hr.com"), ("talentsoft.com", "cegid.com", "cegid-hr.com"), ("talentsoft", "cegid talent")),
    Platform("comeet", ("comeet.co",), ("comeet.co",), ("comeet",)),
    Platform("onlyfy", ("onlyfy.jobs",), ("onlyfy.jobs", "jobbase.io"), ("onlyfy", "prescreen")),
    Platform("breezy", ("breezy.hr",), ("breezy.hr",), ("breezy hr",)),
    Platform("talentlyft", ("talentlyft.com",), ("talentlyft.com",), ("talentlyft",)),
    Platform("personio", ("jobs.personio.de", "jobs.personio.com"), ("personio.de", "personio.com"), ("personio",)),
    Platform("pinpoint", ("pinpointhq.com",), ("pinpointhq.com",), ("pinpointhq",)),
    Platform("jobvite", ("jobs.jobvite.com", "jobvite.com"), ("jobvite.com",), ("jobvite",)),
    Platform("jazzhr", ("applytojob.com", "app.jazz.co"), ("applytojob.com", "jazz.co"), ("jazzhr",)),
    Platform("phenom", (), ("phenompeople.com",), ("phenom people",)),
    Platform("radancy", (), ("talentbrew.com", "tmpwebeng.com", "radancy.net", "radancy.eu"), ("radancy", "talentbrew")),
    Platform("avature", ("avature.net",), ("avature.net", "avacdn.net"), ("avature",)),
    Platform("hibob", ("careers.hibob.com",), ("hibob.com",), ("hibob",)),
    Platform("softgarden", ("softgarden.de", "softgarden.io"), ("softgarden.de", "softgarden.io"), ("softgarden",)),
    Platform("njoyn", ("njoyn.com",), ("njoyn.com",), ("njoyn",)),
    Platform("digitalrecruiters", ("digitalrecruiters.com",), ("digitalrecruiters.com",), ("digitalrecruiters",)),
)
SOURCE_CAP, ATS_CAP = 70, 100
DEFINITIVE, STRONG, SUPPORTING = 1, 2, 3
#: source: (points, tier, distinct URLs needed)
URL_SOURCES = {
    "redirect": (55, 1, 1), "canonical": (50, 1, 1), "script_src": (45, 2, 1), "iframe_src": (45, 2, 1),
    "form_action": (45, 2, 1), "link_href": (40, 2, 1), "anchor": (35, 1, 3), "script_url": (35, 1, 3),
}
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
OWN_RULES = (
    Rule("workday.automation_id", "data_attr", 30, 2, "data", "data-automation-id", "job(?:Posting|Title|PostingHeader)|applyButton"),
    Rule("workday.job_path", "path", 10, 3, "path", r"/job/[^/?#]+/", gated=True),
    Rule("smartrecruiters.api", "script_text", 20, 3, "text", "api.smartrecruiters.com"),
    Rule("greenhouse.gh_jid", "query", 60, 1, "query", "gh_jid", r"\d+"),
    Rule("greenhouse.gh_jid_embed", "dom", 25, 2, "html", "gh_jid="),
    Rule("greenhouse.board_path", "path", 30, 2, "path", r"^/[^/?#]+/jobs/\d+", gated=True),
    Rule("icims.job_path", "path", 45, 1, "path", r"/jobs/\d+/[^/?#]+/job", gated=True),
    Rule("icims.footer", "text", 35, 2, "text", "powered by icims"),
    Rule("successfactors.recruiting_path", "path", 45, 1, "path", "/sf/recruiting/"),
    Rule("successfactors.job_req", "query", 30, 2, "query", "jobReqId"),
    Rule("successfactors.career_site", "script_text", 20, 3, "text", "careersitebuilder"),
    Rule("taleo.careersection", "path", 55, 1, "path", "/careersection/"),
    Rule("taleo.jobdetail", "path", 55, 1, "path", r"jobdetail\.ftl"),
    Rule("taleo.other_ftl", "path", 25, 2, "path", r"(?:jobsearch|jobrefer|careersection)\.ftl"),
    Rule("taleo.job_param", "query", 20, 2, "query", "job", gated=True),
    Rule("lever.posting_uuid", "path", 40, 2, "path", rf"^/[^/?#]+/{UUID}", gated=True),
    Rule("teamtailor.application", "path", 50, 1, "path", r"/jobs/\d+-[^/?#]+/applications/new", gated=True),
    Rule("teamtailor.job_path", "path", 45, 2, "path", r"/(?:careers/)?jobs/\d+-[^/?#]+", gated=True),
    Rule("teamtailor.job_path_generic", "path", 8, 3, "path", r"/(?:careers/)?jobs/\d+-[^/?#]+"),
    Rule("recruitee.js_global", "script_text", 40, 2, "text", "window.recruitee"),
    Rule("recruitee.offers_api", "path", 30, 2, "path", "/api/(?:feeds/)?offers", gated=True),
    Rule("ashby.posting_uuid", "path", 30, 2, "path", rf"^/[^/?#]+/{UUID}", gated=True),
    Rule("ashby.embed", "script_text", 30, 2, "text", "ashby_embed"),
    Rule("workable.job_path", "path", 40, 2, "path", "^/[^/?#]+/j/[^/?#]+", gated=True),
    Rule("bamboohr.job_path", "path", 30, 2, "path", r"/careers/\d+", gated=True),
    Rule("talentsoft.api", "path", 50, 1, "path", r"/api/v\d+/(?:offersummaries|offers/getoffer|applicants)"),
    Rule("comeet.careers_api", "script_text", 40, 2, "text", "careers-api/2.0"),
    Rule("comeet.identifiers", "script_text", 35, 2, "text", "url_comeet_hosted_page"),
    Rule("comeet.job_path", "path", 40, 2, "path", "^/jobs/[^/?#]+/[^/?#]+/[^/?#]+/[^/?#]+", gated=True),
    Rule("breezy.position_path", "path", 45, 2, "path", "/p/[0-9a-f]+", gated=True),
    Rule("talentlyft.api_fields", "script_text", 25, 2, "text", "shortlinkurl"),
    Rule("personio.iframe", "dom", 40, 2, "id", "personio-iframe"),
    Rule("personio.job_path", "path", 45, 2, "path", r"^/job/\d+", gated=True),
    Rule("personio.xml_feed", "path", 40, 2, "path", "^/xml(?:/|$)", gated=True),
    Rule("pinpoint.job_path", "path", 45, 2, "path", r"^/(?:[a-z]{2}(?:-[a-z]{2})?/)?jobs/\d+/?$", gated=True),
    Rule("pinpoint.postings_json", "path", 45, 2, "path", r"/postings\.json", gated=True),
    Rule("pinpoint.api", "path", 45, 2, "path", "^/api/v1/jobs(?:/|$)", gated=True),
    Rule("pinpoint.jobs_block", "dom", 35, 2, "class", "js-careers-jobs-block"),
    Rule("jobvite.iframe_js", "script_src", 45, 2, "url", "careersite/public/iframe.js"),
    Rule("jobvite.careersite_class", "dom", 40, 2, "class", "jv-careersite"),
    Rule("jobvite.careersite_attr", "data_attr", 40, 2, "data", "data-careersite"),
    Rule("jobvite.job_path", "path", 40, 2, "path", "^/[^/?#]+/job/[a-z0-9_-]+", gated=True),
    Rule("jazzhr.widget", "script_src", 40, 2, "url", "jazz.co/widgets/buttons/create/"),
    Rule("jazzhr.apply_path", "path", 40, 2, "path", "^/apply/[a-z0-9]+", gated=True),
    Rule("jazzhr.feed", "path", 40, 2, "path", "/feeds/export/jobs/", gated=True),
)
#: platform: shape of its posting URLs, and whether the query takes part
SHAPES = {
    "teamtailor": (r"/(?:careers/)?jobs/\d+-[^/?#]+", True), "icims": (r"/jobs/\d+/[^/?#]+/job", True), "taleo": (r"jobdetail\.ftl", False),
    "breezy": ("/p/[0-9a-f]+", False), "bamboohr": (r"/careers/\d+", False), "personio": (r"/job/\d+", False), "jazzhr": ("/apply/[a-z0-9]+", False),
    "jobvite": ("/[^/?#]+/job/[a-z0-9_-]+", True), "comeet": ("/jobs/[^/?#]+/[^/?#]+/[^/?#]+/[^/?#]+", True), "pinpoint": (r"/jobs/\d+/?$", True),
    "avature": (r"/externaljobs/jobdetail/\d+", False), "radancy": (r"/job/[^/?#]+/[^/?#]+/\d+/\d+", True), "njoyn": (r"xweb\.asp\?.*\bPage=JobDetails\b.*\bJobid=", True),
}
FEEDS = (
    Feed("greenhouse", "https://boards-api.greenhouse.io/v1/boards/{token}/jobs", (r"[?&]for=([\w.-]+)", r"greenhouse\.io/(?:embed/)?([\w.-]+)"), "jobs", "title", "location", "absolute_url"),
    Feed("lever", "https://api.lever.co/v0/postings/{token}?mode=json", (r"jobs\.lever\.co/([\w.-]+)",), "", "text", "categories.location", "hostedUrl"),
    Feed("ashby", "https://api.ashbyhq.com/posting-api/job-board/{token}", (r"ashbyhq\.com/([\w.-]+)",), "jobs", "title", "location", "jobUrl"),
    Feed("recruitee", "https://{token}.recruitee.com/api/offers/", (r"//([\w-]+)\.recruitee\.com",), "offers", "title", "location", "careers_url"),
    Feed("workable", "https://apply.workable.com/api/v1/widget/accounts/{token}?details=true", (r"apply\.workable\.com/([\w.-]+)", r"//([\w-]+)\.workable\.com"), "jobs", "title", "city", "url"),
    Feed("smartrecruiters", "https://api.smartrecruiters.com/v1/companies/{token}/postings?limit=100", (r"smartrecruiters\.com/([\w.-]+)",), "content", "name", "location", link_url="https://jobs.smartrecruiters.com/{token}/{id}", total="totalFound", param="offset"),
    Feed("breezy", "https://{token}.breezy.hr/json", (r"//([\w-]+)\.breezy\.hr",), "", "name", "location.city", "url"),
    Feed("bamboohr", "https://{token}.bamboohr.com/careers/list", (r"//([\w-]+)\.bamboohr\.com",), "result", "jobOpeningName", "atsLocation.city", link_url="https://{token}.bamboohr.com/careers/{id}"),
    Feed("pinpoint", "https://{token}.pinpointhq.com/postings.json", (r"//([\w-]+)\.pinpointhq\.com",), "data", "title", "location.city", "url"),
    Feed("personio", "https://{token}.jobs.personio.de/xml", (r"//([\w-]+)\.jobs\.personio\.(?:de|com)",), "", "name", "office", link_url="https://{token}.jobs.personio.de/job/{id}", item_tag="position"),
    Feed("jazzhr", "https://app.jazz.co/feeds/export/jobs/{token}", (r"//([\w-]+)\.applytojob\.com", r"//([\w-]+)\.jazz\.co"), "", "title", "city", "url", item_tag="job"),
)
INFRA = (
    "google", "gstatic", "googleapis", "doubleclick", "gtm", "bing", "facebook", "linkedin", "twitter", "x.com", "bsky.app", "instagram",
    "tiktok", "youtube", "vimeo", "apple.com", "amazon.com", "aws.amazon", "cloudflare", "cloudfront", "akamai", "fastly", "azurefd", "b-cdn.net",
    "jsdelivr", "unpkg", "bootstrapcdn", "jquery", "icomoon", "typography", "typekit", "fontawesome", "weglot",
    "hubspot", "hs-scripts", "hs-analytics", "hsforms", "hubapi", "segment", "sentry", "newrelic", "hotjar", "matomo", "piwik", "posthog",
    "clarity.ms", "atinternet", "aticdn", "elfsight", "tidio", "wp.com", "usercentrics", "trustarc", "cookieyes", "onetrust", "tarteaucitron",
    "axeptio", "cookiebot", "hcaptcha", "recaptcha", "cookielaw", "iubenda", "website-editor.net", "website-files.com", "windows.net", "bugherd",
    "cr-relay.com", "s81c.com", "cloudinary", "adobeaemcloud", "brightcove", "mux.com", "indeed.com", "glassdoor", "welcometothejungle", "jobijoba",
    "hellowork",
)
#: Hosts that only a vendor serves, and marks in a page that only its infrastructure leaves: labels of a test corpus.
OWNED_HOSTS = {
    "myworkdayjobs.com": "workday", "smartrecruiters.com": "smartrecruiters", "boards.greenhouse.io": "greenhouse", "job-boards.greenhouse.io": "greenhouse", "icims.com": "icims",
    "taleo.net": "taleo", "jobs.lever.co": "lever", "teamtailor.com": "teamtailor", "recruitee.com": "recruitee", "jobs.ashbyhq.com": "ashby", "apply.workable.com": "workable",
    "bamboohr.com": "bamboohr", "comeet.co": "comeet", "onlyfy.jobs": "onlyfy", "breezy.hr": "breezy", "talentlyft.com": "talentlyft", "jobs.personio.de": "personio",
    "jobs.personio.com": "personio", "pinpointhq.com": "pinpoint", "jobs.jobvite.com": "jobvite", "applytojob.com": "jazzhr", "app.jazz.co": "jazzhr", "avature.net": "avature",
    "careers.hibob.com": "hibob", "njoyn.com": "njoyn", "softgarden.de": "softgarden", "digitalrecruiters.com": "digitalrecruiters",
}
ASSET_MARKERS = {
    "teamtailor-cdn.com": "teamtailor", "app.teamtailor.com": "teamtailor", "cdn.lever.co": "lever", "jobs.lever.co": "lever", "app.ashbyhq.com": "ashby", "jobs.ashbyhq.com": "ashby",
    "jobs.smartrecruiters.com": "smartrecruiters", "api.smartrecruiters.com": "smartrecruiters", "apply.workable.com": "workable", "api.breezy.hr": "breezy",
    "boards.greenhouse.io": "greenhouse", "job-boards.greenhouse.io": "greenhouse", "jobs.jobvite.com": "jobvite", "jobs.personio.de": "personio", "applytojob.com": "jazzhr",
    "myworkdayjobs.com": "workday", "cdn.phenompeople.com": "phenom", "tbcdn.talentbrew.com": "radancy", "tmpwebeng.com": "radancy", "front.hibob.com": "hibob",
    "api.digitalrecruiters.com": "digitalrecruiters", "career.softgarden.de": "softgarden",
}
# --- end of fixed values ---

INDEX = {a.name: i for i, a in enumerate(ATS)}


def known_domains() -> list[str]:
    return sorted({d for a in ATS for d in (*a.hosts, *a.assets)})


#: Platforms that are read by a connector of their own (see ``sources.connectors``).
CONNECTORS = ("workday", "comeet", "njoyn")


def platform_readers() -> list[tuple[str, str, str | None]]:
    """``(ats, reader, endpoint)`` of each platform: its feed, its own connector, links of its posting shape, or only what reads any page."""
    feeds = {f.ats: f.endpoint for f in FEEDS}

    def reader(name: str) -> str:
        if name in feeds:
            return "feed"
        if name in CONNECTORS:
            return "connector"
        return "links" if name in SHAPES else "general"

    return [(a.name, reader(a.name), feeds.get(a.name)) for a in ATS]


def all_rules() -> list[Rule]:
    """Every rule in firing order: of each platform its host, URL sources, structured data, own rules, text and metadata."""
    rules: list[Rule] = []
    for a in ATS:
        if a.hosts:
            rules.append(Rule(f"{a.name}.hostname", "hostname", 60, DEFINITIVE, "hostname", ""))
        for source, (points, tier, hits) in URL_SOURCES.items():
            rules.append(Rule(f"{a.name}.{source}", source, points, tier, "domain", str(hits)))
        rules.append(Rule(f"{a.name}.jsonld", "jsonld", 25, STRONG, "jsonld", ""))
        rules += [r for r in OWN_RULES if r.ats == a.name]
        rules.append(Rule(f"{a.name}.text", "text", 2, SUPPORTING, "terms", "\n".join(a.terms)))
        rules.append(Rule(f"{a.name}.meta", "meta", 2, SUPPORTING, "meta", "\n".join(a.terms)))
    return rules
