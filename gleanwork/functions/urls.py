"""URL functions as Column expressions; none raises on any input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanwork.plans.registry import ATS

# --- fixed values: words and shapes that decide what counts as a posting URL ---
JOB_WORD = (
    r"(?:jobs?|offres?|offers?|emplois?|postes?|annonces?|vacanc(?:y|ies)|positions?|openings?|opportunit(?:y|ies)|"
    r"careers?|carrieres?|stellen?|recrutement)"
)
JOB_SLUG = r"(?:[^/?#]*[-_][^/?#]*|\d{3,})"
GENERIC_SEGMENTS = (
    "job", "jobs", "offre", "offres", "emploi", "emplois", "career", "careers", "carriere", "carrieres", "vacancy", "vacancies", "position",
    "positions", "opening", "openings", "detail", "details", "posting", "postings", "stelle", "stellen", "recrutement", "vacature", "vacatures",
)
SKIP_TITLES = (
    "skip to main content", "skip to content", "skip to job description", "learn more", "read more", "see more", "show more", "view details",
    "view job", "view job details", "view all jobs", "apply", "apply now", "details", "en savoir plus", "voir l'offre", "voir loffre", "voir plus",
    "voir toutes les offres", "postuler", "en savoir +", "lire la suite", "mehr erfahren", "jetzt bewerben",
)
NESTED_SITEMAP = r"(?i)job|offre|emploi|vacanc|career|stellen"
#: The job word must be followed by a slash or up to two more segments, so no lookahead is needed.
JOB_URL_SHAPE = rf"/(?:\w+-)?{JOB_WORD}(?:-d?-?{JOB_WORD})?(?:/[^/?#]+){{0,2}}/{JOB_SLUG}"
# --- end of fixed values ---

JOB_URL = f"(?iuU){JOB_URL_SHAPE}"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def path_of(url: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(_c(url), F.lit("")), _PATH, 1)


def query_of(url: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(_c(url), F.lit("")), r"^[^?#]*\?([^#]*)", 1)


def scheme_of(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(_c(url), F.lit("")), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def normal_host(host: Column | str) -> Column:
    """Trimmed, lower case, without port and final dot."""
    return F.regexp_replace(F.split_part(F.lower(F.trim(_c(host))), F.lit(":"), F.lit(1)), r"\.+$", "")


def host_of(url: Column | str) -> Column:
    """Host of an absolute or scheme-relative URL, else ""."""
    authority = F.regexp_extract(F.coalesce(_c(url), F.lit("")), _AUTHORITY, 1)
    return normal_host(F.regexp_replace(authority, "^.*@", ""))


def norm_url(url: Column | str) -> Column:
    """Without fragment and final slashes: the key on which postings are one."""
    return F.regexp_replace(F.split_part(_c(url), F.lit("#"), F.lit(1)), "/+$", "")


def same_page(a: Column | str, b: Column | str) -> Column:
    return norm_url(a) == norm_url(b)


def registrable(host: Column | str) -> Column:
    """Last two labels; a host of one label is its own."""
    labels = F.split(_c(host), r"\.")
    return F.when(F.size(labels) < 2, _c(host)).otherwise(F.array_join(F.slice(labels, -2, 2), "."))


def host_suffixes(host: Column | str) -> Column:
    """The host and each of its parent domains, longest first: what a domain list is joined on."""
    labels = F.split(_c(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def host_in(host: Column | str, domains: Sequence[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    out = F.lit(False)
    for d in domains:
        out = out | (_c(host) == d) | _c(host).endswith(f".{d}")
    return out


def query_values(url: Column | str) -> Column:
    """Query as map of lower-case name to values, blank ones included."""
    pairs = F.filter(F.split(query_of(url), "&"), lambda p: p != "")

    def decoded(x: Column) -> Column:
        return F.coalesce(F.try_url_decode(x), x)

    named = F.transform(pairs, lambda p: F.struct(F.lower(decoded(F.split_part(p, F.lit("="), F.lit(1)))).alias("k"), decoded(F.regexp_extract(p, "^[^=]*=?(.*)$", 1)).alias("v")))
    keys = F.array_distinct(F.transform(named, lambda x: x["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(named, lambda x: x["k"] == k), lambda x: x["v"])))


def _capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))


def title_from_url(url: Column | str) -> Column:
    """Title in the path's last segment that holds words, else "".

    Segments are percent-decoded (a malformed one is taken as it is), a page
    extension and a record id in front are dropped, and bare ids and generic
    segments are passed over.
    """
    path = F.regexp_replace(path_of(url), r";[^/]*$", "")
    segments = F.reverse(F.filter(F.split(path, "/"), lambda s: s != ""))

    def read(segment: Column) -> Column:
        slug = F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment)
        slug = F.regexp_replace(slug, r"(?i)\.(?:html?|aspx?|php|jsp)$", "")
        named = F.regexp_replace(slug, r"(?i)^(?=[0-9a-z]*\d)[0-9a-z]{6,}[-_]", "")
        words = F.filter(F.split(named, r"(?U)[-_+\s]+"), lambda w: w != "")
        title = F.array_join(F.transform(words, _capitalised), " ")
        return F.when(F.rlike(slug, F.lit(r"^(?i)(?:\d+|[0-9a-f]{8,})$")) | F.lower(title).isin(*GENERIC_SEGMENTS), F.lit("")).otherwise(title)

    titles = F.filter(F.transform(segments, read), lambda t: t != "")
    return F.when(F.size(titles) > 0, F.element_at(titles, 1)).otherwise(F.lit(""))


def is_posting_path(path: Column | str) -> Column:
    return F.rlike(F.coalesce(_c(path), F.lit("")), F.lit(JOB_URL))


def link_target(url: Column | str, match_query: Column | bool) -> Column:
    """What a posting shape is matched against: the path, with the query where asked for."""
    query = query_of(url)
    wanted = F.lit(match_query) if isinstance(match_query, bool) else match_query
    return F.when(wanted & (query != ""), F.concat(path_of(url), F.lit("?"), query)).otherwise(path_of(url))


def is_boilerplate(label: Column) -> Column:
    """Whether an anchor's label names an action rather than a posting."""
    return F.regexp_replace(F.lower(label), "[ .>→]+$", "").isin(*SKIP_TITLES)


def is_nested_sitemap(url: Column) -> Column:
    return F.lower(url).endswith(".xml") & F.rlike(url, F.lit(NESTED_SITEMAP))


def ats_from_host(url: Column | str) -> Column:
    """Platform that owns the URL's host, by registry order; null if none does."""
    host = host_of(url)
    return F.coalesce(*[F.when(host_in(host, a.hosts), F.lit(a.name)) for a in ATS if a.hosts])


def with_param(url: Column, name: Column, value: Column) -> Column:
    """URL with a paging parameter; the first page has none."""
    joint = F.when(F.instr(url, "?") > 0, F.lit("&")).otherwise(F.lit("?"))
    return F.when((F.coalesce(name, F.lit("")) == "") | (value == 0), url).otherwise(F.concat(url, joint, name, F.lit("="), value.cast("string")))


def first_token(urls: Sequence[Column], patterns: Sequence[str]) -> Column:
    """First group of the first pattern that matches, each URL in turn."""
    found = [F.nullif(F.regexp_extract(F.coalesce(u, F.lit("")), p, 1), F.lit("")) for u in urls for p in patterns]
    return F.coalesce(*found)


def resolve(base: Column, link: Column) -> Column:
    """Absolute form of absolute, scheme-relative, root-relative, query, fragment and plain relative links."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#]*)?)", 1)
    link = F.trim(link)
    folder = F.regexp_extract(path_of(base), "^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), link)
        .when(link.startswith("//"), F.concat(scheme_of(base), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("#"), F.concat(F.split_part(base, F.lit("#"), F.lit(1)), link))
        .when(link.startswith("?"), F.concat(root, path_of(base), link))
        .when(link == "", base)
        .otherwise(F.concat(root, folder, link))
    )


LOCALE = r"(?i)^[a-z]{2}(-[a-z]{2})?$"


def workday_endpoint(url: Column | str) -> Column:
    """Struct ``root, tenant, segments`` of a tenant's API, the locale segment dropped; null without host or path."""
    host = host_of(url)
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    segments = F.when((F.size(segments) > 0) & F.rlike(F.get(segments, F.lit(0)), F.lit(LOCALE)), F.slice(segments, F.lit(2), F.size(segments))).otherwise(segments)
    tenant = F.split_part(host, F.lit("."), F.lit(1))
    made = F.struct(F.concat(scheme_of(url), F.lit("://"), host).alias("root"), tenant.alias("tenant"), segments.alias("segments"))
    return F.when((tenant != "") & (F.size(segments) > 0), made)


def workday_api(url: Column | str) -> Column:
    """JSON endpoint of one posting."""
    at = workday_endpoint(url)
    return F.when(at.isNotNull(), F.concat_ws("/", at["root"], F.lit("wday/cxs"), at["tenant"], F.array_join(at["segments"], "/")))
