"""Postings from boards, over a table of fetches.

Each connector is a join of boards with fetched bodies and a projection, so
it runs on stored fetches as well as on fresh ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanwork.functions import html as H
from gleanwork.functions import jsonx as J
from gleanwork.functions import urls as U
from gleanwork.plans.registry import FEEDS, SHAPES, Feed
from gleanwork.sources.shared import materialise

# --- fixed values ---
LOC = r"(?i)<loc>\s*([^<\s]+)\s*</loc>"
ROBOTS = r"(?im)^\s*sitemap:\s*(\S+)"
COMEET_UID = r'"company_uid"\s*:\s*"([\w.]+)"'
COMEET_TOKEN = r'"token"\s*:\s*"([0-9A-Fa-f]{16,})"'
COMEET_API = "https://www.comeet.co/careers-api/2.0/company/{uid}/positions?token={token}"
WORDPRESS_MARKER = r"(?i)wp-content|wp-json"
WORDPRESS_TYPE = r"(?i)job|offre|emploi|career|carriere|poste|recrut|vacan"
MIN_SITEMAP_JOBS, SITEMAP_REQUESTS, MAX_DETAIL = 3, 4, 200
FEED_PAGES, FEED_PAGE, WORDPRESS_PAGE, WORDPRESS_PAGES, WORKDAY_PAGE, WORKDAY_PAGES = 100, 100, 100, 20, 20, 50
# --- end of fixed values ---

JOBS = ["board_url", "company", "title", "url", "place", "via"]
ORDER = ("feed", "wordpress", "sitemap", "links", "rendered")


def _filled(*names: str) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(n), F.lit("")) != "" for n in names])


def templated(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def bodies_of(fetches: DataFrame) -> DataFrame:
    """``_url, body`` of fetches that went well, to be joined by sorting.

    There are as many as postings, and Parquet makes them look small: read as
    such they would be broadcast, which holds them in the driver.
    """
    return fetches.where("status = 200").select(F.col("url").alias("_url"), "body").hint("merge")


def of_feed(feeds: Sequence[Feed], value: Callable[[Feed], Column]) -> Column:
    """What a row's platform has by its feed, null for other platforms."""
    return F.coalesce(*[F.when(F.col("ats") == f.ats, value(f)) for f in feeds])


def feed_requests(boards: DataFrame, feed: Feed) -> DataFrame:
    """First request of each board of a feed's platform: ``token, endpoint``; boards without a token go."""
    token = U.first_token([F.col("final_url"), F.col("board_url")], feed.tokens)
    rows = boards.where(F.col("ats") == feed.ats).withColumn("token", token).where("token is not null")
    return rows.withColumn("endpoint", templated(feed.endpoint, token=F.col("token")))


def feed_page_urls(requests: DataFrame, fetches: DataFrame, feed: Feed) -> DataFrame:
    """``requests`` with ``offset`` and ``_page`` of each page known so far: the first, and in paged feeds those up to the total that it states."""
    first = requests.withColumn("offset", F.lit(0).cast("long")).withColumn("_page", F.col("endpoint"))
    if not feed.param:
        return first
    bodies = bodies_of(fetches)
    total = F.coalesce(F.try_variant_get(F.try_parse_json("body"), f"$.{feed.total}", "bigint"), F.lit(0))
    more = requests.join(bodies, F.col("endpoint") == F.col("_url")).withColumn("_last", F.least((total - 1).cast("long"), F.lit((FEED_PAGES - 1) * FEED_PAGE))).where(F.col("_last") >= FEED_PAGE)
    more = more.withColumn("offset", F.explode(F.sequence(F.lit(FEED_PAGE), F.col("_last"), F.lit(FEED_PAGE)))).drop("_last", "body", "_url")
    return first.unionByName(more.withColumn("_page", U.with_param(F.col("endpoint"), F.lit(feed.param), F.col("offset").cast("string"))))


def feed_pages(boards: DataFrame, fetches: DataFrame) -> DataFrame:
    """``board_url, company, ats, token, body``: fetched pages of all feeds, by one join. Paged feeds state a total; pages follow until it is seen."""
    asked = [feed_page_urls(feed_requests(boards, f), fetches, f).select("board_url", "company", "ats", "token", "_page") for f in FEEDS]
    return reduce(DataFrame.unionByName, asked).join(bodies_of(fetches), F.col("_page") == F.col("_url")).drop("_url", "_page")


#: How feeds in XML are read: names without prefix, white space as it is, and what cannot be parsed set aside.
XML_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "ignoreNamespace": "true", "attributePrefix": "_attr_", "valueTag": "_text", "ignoreSurroundingSpaces": "false"}


def xml_type(tag: str, fields: Sequence[str]) -> str:
    """Type of a feed whose root holds ``tag`` elements; a dotted field is a leaf inside another element."""
    tree: dict = {}
    for f in fields:
        at = tree
        for part in f.split("."):
            at = at.setdefault(part, {})
    kind = lambda node: "struct<" + ", ".join(f"`{k}`: {kind(v) if v else 'string'}" for k, v in node.items()) + ">"
    return f"struct<`{tag}`: array<{kind(tree)}>, `_broken`: string>"


def xml_parsed(body: Column | str, tag: str, fields: Sequence[str]) -> Column:
    """A feed's elements; ``_broken`` holds the body if it is no XML."""
    return F.from_xml(body, xml_type(tag, fields), XML_OPTIONS)


def xml_leaf(item: Column, field: str) -> Column:
    """Stripped text of an element's leaf, null if there is none."""
    return F.nullif(F.trim(reduce(Column.getField, field.split("."), item)), F.lit(""))


def xml_records(bodies: DataFrame, tag: str, fields: list[str], body: str = "body") -> DataFrame:
    """A row for each ``tag`` element below the root, with the stripped texts of its leaves as ``item_<leaf>``; missing ones are null.

    Comments, CDATA, attributes and elements of the same name inside others are
    the parser's matter. Bodies that are no XML give no rows.
    """
    rows = bodies.withColumn("_feed", xml_parsed(body, tag, fields)).where(F.col("_feed._broken").isNull())
    rows = rows.select("*", F.posexplode(F.col(f"_feed.`{tag}`")).alias("pos", "_item")).drop("_feed")
    return rows.select("*", *[xml_leaf(F.col("_item"), f).alias(f"item_{f}") for f in fields]).drop("_item")


def xml_feed_items(body: Column, feed: Feed) -> Column:
    """Items of a feed in XML as ``J.feed_items`` gives those of one in JSON; null if it is no XML."""
    leaves = {"id": "id", "title": feed.title, "place": feed.place, "link": feed.link}
    parsed = xml_parsed(body, feed.item_tag, sorted({x for x in leaves.values() if x}))
    item = lambda x: F.struct(*[(xml_leaf(x, f) if f else F.lit(None).cast("string")).alias(name) for name, f in leaves.items()])
    return F.when(parsed["_broken"].isNull(), F.transform(parsed[feed.item_tag], item))


def feed_postings(boards: DataFrame, fetches: DataFrame) -> DataFrame:
    """Postings of all boards whose platform has a feed; items without title, URL or (where it makes the URL) id go."""
    xml = [f for f in FEEDS if f.item_tag]
    json = [f for f in FEEDS if not f.item_tag]
    paths = [of_feed(json, lambda f, name=name: F.lit(getattr(f, name))) for name in ("items", "title", "place", "link")]
    own = lambda *feeds: F.when(F.col("ats").isin([f.ats for f in feeds]), F.col("body"))
    items = F.coalesce(*[xml_feed_items(own(f), f) for f in xml], J.feed_items(own(*json), *paths))
    rows = feed_pages(boards, fetches).select("board_url", "company", "ats", "token", F.explode(items).alias("i")).select("board_url", "company", "ats", "token", "i.*")
    url = of_feed(FEEDS, lambda f: templated(f.link_url, token=F.col("token"), id=F.col("id")) if f.link_url else F.col("link"))
    return rows.withColumn("url", url).withColumn("via", F.lit("feed")).where(_filled("title", "url")).select(*JOBS)


def workday_endpoints(boards: DataFrame) -> DataFrame:
    """Workday boards with ``endpoint`` and the base of their postings' URLs."""
    at = U.workday_endpoint("board_url")
    rows = boards.where("ats = 'workday'").withColumn("_at", at).where("_at is not null")
    rows = rows.withColumn("endpoint", F.concat(F.col("_at.root"), F.lit("/wday/cxs/"), F.col("_at.tenant"), F.lit("/"), F.get("_at.segments", F.lit(0)), F.lit("/jobs")))
    return rows.withColumn("_base", F.regexp_replace(F.regexp_extract("board_url", r"^([^?#]*)", 1), "/+$", ""))


def workday_pages(boards: DataFrame, fetches: DataFrame) -> DataFrame:
    """Fetched pages of Workday boards with ``offset`` and ``items``, up to the first short one."""
    rows = workday_endpoints(boards)
    posts = fetches.where("lower(method) = 'post' and status = 200").select(F.col("url").alias("_url"), F.get_json_object("request_body", "$.offset").cast("long").alias("offset"), "body").hint("merge")
    items = J.feed_items("body", F.lit("jobPostings"), F.lit("title"), F.lit("locationsText"), F.lit("externalPath"))
    pages = rows.join(posts, F.col("endpoint") == F.col("_url")).withColumn("items", items)
    before = Window.partitionBy("board_url").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    short = F.coalesce(F.max(F.size("items") < WORKDAY_PAGE).over(before), F.lit(False))
    return pages.withColumn("_short", short).where(~F.col("_short") & (F.col("offset") < WORKDAY_PAGE * WORKDAY_PAGES)).drop("_short", "_url", "body")


def workday_postings(boards: DataFrame, fetches: DataFrame) -> DataFrame:
    """Workday boards: pages of 20 by POST, up to the first short one; ``request_body`` holds the offset."""
    pages = workday_pages(boards, fetches)
    jobs = pages.select("board_url", "company", "_base", F.explode("items").alias("i")).select("board_url", "company", F.trim("i.title").alias("title"), F.col("i.link").alias("_path"), F.concat("_base", "i.link").alias("url"), F.nullif(F.trim("i.place"), F.lit("")).alias("place"), F.lit("workday").alias("via"))
    return jobs.where(_filled("title", "_path")).select(*JOBS)


def comeet_endpoints(boards: DataFrame) -> DataFrame:
    """Comeet boards with ``endpoint``, from the company id and token in their page."""
    uid, token = F.regexp_extract("html", COMEET_UID, 1), F.regexp_extract("html", COMEET_TOKEN, 1)
    rows = boards.where("ats = 'comeet'").withColumn("_uid", uid).withColumn("_token", token).where("_uid <> '' and _token <> ''")
    return rows.withColumn("endpoint", templated(COMEET_API, uid=F.col("_uid"), token=F.col("_token")))


def comeet_postings(boards: DataFrame, fetches: DataFrame) -> DataFrame:
    """Comeet boards: company id and token from the page, then one JSON request."""
    rows = comeet_endpoints(boards)
    items = J.feed_items("body", F.lit(""), F.lit("name"), F.lit("location.city"), F.lit("url_comeet_hosted_page"))
    met = rows.join(bodies_of(fetches), F.col("endpoint") == F.col("_url"))
    jobs = met.select("board_url", "company", F.explode(items).alias("i")).select("board_url", "company", "i.title", F.col("i.link").alias("url"), "i.place", F.lit("comeet").alias("via"))
    return jobs.where(_filled("title", "url")).select(*JOBS)


def table_records(pages: DataFrame, html: str = "html", base: str = "board_url") -> DataFrame:
    """Data rows of a page's tables: ``table, row, header, cells, hrefs``."""
    return pages.select("*", F.explode(H.html_table_rows(html, base)).alias("_r")).select("*", "_r.*").drop("_r")


def njoyn_postings(boards: DataFrame) -> DataFrame:
    """Rows of tables with a title column and a link to a posting; columns are found by name."""
    rows = table_records(boards.where("ats = 'njoyn'"))
    cell = lambda name: F.try_element_at("cells", F.nullif(F.array_position("header", name), F.lit(0)).cast("int"))
    link = F.get(F.filter("hrefs", lambda u: F.rlike(u, F.lit("(?i)Page=JobDetails"))), F.lit(0))
    jobs = rows.select("board_url", "company", cell("title").alias("title"), link.alias("url"), F.nullif(cell("city"), F.lit("")).alias("place"), F.lit("njoyn").alias("via"))
    return jobs.where(_filled("title", "url")).select(*JOBS)


def root_of(url: Column | str) -> Column:
    return F.concat(U.scheme_of(url), F.lit("://"), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def wordpress_types(boards: DataFrame) -> DataFrame:
    """Boards whose page has WordPress marks, with the ``endpoint`` that lists their post types."""
    rows = boards.where(F.rlike(F.coalesce("html", F.lit("")), F.lit(WORDPRESS_MARKER))).withColumn("_root", root_of("board_url"))
    return rows.withColumn("endpoint", F.concat("_root", F.lit("/wp-json/wp/v2/types")))


def wordpress_pages(boards: DataFrame, fetches: DataFrame) -> DataFrame:
    """``board_url, company, page, _page``: the pages of the first job-like post type of boards whose types were fetched."""
    ok = bodies_of(fetches)
    types = wordpress_types(boards).join(ok, F.col("endpoint") == F.col("_url")).withColumn("_names", F.json_object_keys("body"))
    kind = F.get(F.filter("_names", lambda n: F.rlike(n, F.lit(WORDPRESS_TYPE))), F.lit(0))
    types = types.select("board_url", "company", "_root", kind.alias("_type")).where("_type is not null")
    return types.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(WORDPRESS_PAGES)))).withColumn("_page", F.concat("_root", F.lit("/wp-json/wp/v2/"), "_type", F.lit(f"?per_page={WORDPRESS_PAGE}&page="), F.col("page").cast("string")))


def wordpress_read(boards: DataFrame, fetches: DataFrame) -> DataFrame:
    """Fetched pages with ``items``, up to the first short one."""
    ok = bodies_of(fetches)
    items = J.feed_items("body", F.lit(""), F.lit("title.rendered"), F.lit("-"), F.lit("link"))
    pages = wordpress_pages(boards, fetches).join(ok, F.col("_page") == F.col("_url")).withColumn("items", items)
    before = Window.partitionBy("board_url").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("_short", F.coalesce(F.max(F.size("items") < WORDPRESS_PAGE).over(before), F.lit(False))).where(~F.col("_short")).drop("_short", "_url", "body")


def wordpress_postings(boards: DataFrame, fetches: DataFrame) -> DataFrame:
    """WordPress boards (by their page's markers): the first job-like post type, pages of 100 up to the first short one."""
    pages = wordpress_read(boards, fetches)
    jobs = pages.select("board_url", "company", F.explode("items").alias("i")).select("board_url", "company", H.html_unescape("i.title").alias("title"), F.col("i.link").alias("url"), F.lit(None).cast("string").alias("place"), F.lit("wordpress").alias("via"))
    return jobs.where(_filled("title", "url")).select(*JOBS)


def sitemap_urls(xml: Column | str) -> Column:
    """Distinct posting URLs of a sitemap, in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(xml, F.lit(LOC), F.lit(1)), lambda u: U.is_posting_path(U.path_of(u))))


def nested_sitemaps(xml: Column | str) -> Column:
    return F.filter(F.regexp_extract_all(xml, F.lit(LOC), F.lit(1)), U.is_nested_sitemap)


def find_sitemaps(boards: DataFrame, fetches: DataFrame) -> DataFrame:
    """``board_url, sitemap, jobs`` of boards with a sitemap of three postings or more, by a budget of four requests."""
    return sitemap_search(boards, fetches).where("sitemap is not null").select("board_url", "sitemap", "jobs")


def sitemap_search(boards: DataFrame, fetches: DataFrame) -> DataFrame:
    """``board_url, sitemap, jobs, next``: what the search has found, and the first place it asks for that ``fetches`` has not.

    Each round takes one request of every open board: the two usual places,
    then job-like children of an index, then those robots.txt names. The loop
    has as many rounds as requests, whatever the number of boards; a board's
    queue is an array on its row. Postings are read once the search is over,
    and boards that ask nothing more meet by a key of their own, not all by null.
    """
    known = fetches.groupBy(F.col("url").alias("_url")).agg(F.max(F.when(F.col("status") == 200, F.col("body"))).alias("body")).hint("merge")
    root = root_of("board_url")
    empty = F.array().cast("array<string>")
    asked_or_own = lambda c: F.coalesce(c, F.concat(F.lit("\n"), "board_url"))  # noqa: E731  (no fetched URL begins with a line end)
    rows = boards.select("board_url").distinct().withColumn("_root", root).select(
        "board_url", "_root", F.array(F.concat("_root", F.lit("/sitemap.xml")), F.concat("_root", F.lit("/sitemap_index.xml"))).alias("queue"), empty.alias("nested"), empty.alias("seen"),
        F.lit(False).alias("robots"), F.lit(None).cast("string").alias("sitemap"), F.lit(None).cast("string").alias("next"),
    )
    for _ in range(SITEMAP_REQUESTS):
        fresh = F.array_except("queue", "seen")
        nested = F.array_except("nested", "seen")
        rows = rows.withColumn("queue", F.when(F.size(fresh) > 0, fresh).otherwise(nested)).withColumn("nested", F.when(F.size(fresh) > 0, F.col("nested")).otherwise(empty))
        ask_robots = (F.size("queue") == 0) & ~F.col("robots")
        target = F.when(F.col("sitemap").isNotNull(), F.lit(None)).when(ask_robots, F.concat("_root", F.lit("/robots.txt"))).otherwise(F.get("queue", F.lit(0)))
        rows = rows.withColumn("_ask", ask_robots).withColumn("_target", target).withColumn("_key", asked_or_own("_target")).join(known, F.col("_key") == F.col("_url"), "left")
        named = F.transform(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(ROBOTS), F.lit(1)), lambda u: U.resolve(F.col("_root"), u))
        hit = F.col("sitemap").isNull() & ~F.col("_ask") & (F.size(sitemap_urls(F.coalesce("body", F.lit("")))) >= MIN_SITEMAP_JOBS)
        rows = rows.select(
            "board_url", "_root", F.when(F.col("_ask"), named).otherwise(F.slice("queue", F.lit(2), F.greatest(F.size("queue"), F.lit(1)))).alias("queue"),
            F.when(F.col("_ask"), F.col("nested")).otherwise(F.concat("nested", nested_sitemaps(F.coalesce("body", F.lit(""))))).alias("nested"),
            F.when(F.col("_target").isNull(), F.col("seen")).otherwise(F.concat("seen", F.array("_target"))).alias("seen"), (F.col("robots") | F.col("_ask")).alias("robots"),
            F.when(hit, F.col("_target")).otherwise(F.col("sitemap")).alias("sitemap"),
            F.coalesce("next", F.when(F.col("_url").isNull(), F.col("_target"))).alias("next"),
        )
    rows = rows.select("board_url", "sitemap", "next").withColumn("_key", asked_or_own("sitemap")).join(known, F.col("_key") == F.col("_url"), "left")
    return rows.select("board_url", "sitemap", F.when(F.col("sitemap").isNotNull(), sitemap_urls("body")).otherwise(empty).alias("jobs"), "next")


def sitemap_postings(boards: DataFrame, fetches: DataFrame) -> DataFrame:
    """Postings of sitemaps; the first 200 of a board take title and place from their pages' JSON-LD, the rest the URL's title."""
    companies = boards.select("board_url", "company").dropDuplicates(["board_url"]).hint("merge")
    urls = find_sitemaps(boards, fetches).join(companies, "board_url").select("board_url", "company", F.posexplode("jobs").alias("pos", "url"))
    with_blocks = F.when(F.rlike("body", F.lit("(?i)<script")), F.col("body"))  # only these can hold JSON-LD; sitemaps are no trees to walk
    ok = fetches.where("status = 200").select(F.col("url").alias("_url"), H.extract_detail(with_blocks).alias("d")).select("_url", "d.jsonld.title", "d.jsonld.place").hint("merge")
    met = urls.join(ok, (F.col("url") == F.col("_url")) & (F.col("pos") < MAX_DETAIL), "left")
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), U.title_from_url("url"))
    return met.select("board_url", "company", title.alias("title"), "url", "place", F.lit("sitemap").alias("via"))


def shapes_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, s, q) for a, (s, q) in SHAPES.items()], "shape_ats string, shape string, match_query boolean")


def link_postings(boards: DataFrame, html: str = "html", via: str = "links") -> DataFrame:
    """Anchors whose URL has its platform's posting shape (or the general one).

    The title is the label, else the card's heading, else the URL's: labels of
    unfitting length and boilerplate ones do not count. Links to the page
    itself go.
    """
    shapes = F.broadcast(shapes_table(boards.sparkSession))
    rows = boards.join(shapes, F.col("ats") == F.col("shape_ats"), "left").select("board_url", "company", "shape", F.coalesce("match_query", F.lit(True)).alias("_q"), F.explode(H.html_anchors(html, "board_url")).alias("a"))
    rows = rows.select("board_url", "company", "shape", "_q", "a.*").where(~U.same_page("url", "board_url"))
    target = U.link_target("url", F.col("_q"))
    pattern = F.coalesce(F.concat(F.lit("(?iuU)"), F.col("shape")), F.lit(U.JOB_URL))
    rows = rows.where(F.rlike(target, pattern))
    fits = (F.length("label") >= H.MIN_TITLE) & (F.length("label") <= H.MAX_TITLE) & ~U.is_boilerplate(F.col("label"))
    title = F.coalesce(F.when(fits, F.col("label")), F.nullif(F.col("card_title"), F.lit("")), U.title_from_url("url"))
    return rows.select("board_url", "company", "pos", title.alias("title"), "url", F.lit(None).cast("string").alias("place"), F.lit(via).alias("via"))


def first_strategy(postings: DataFrame) -> DataFrame:
    """Of a board's postings those of its first strategy that found any."""
    rank = F.coalesce(*[F.when(F.col("via") == v, F.lit(i)) for i, v in enumerate(ORDER)], F.lit(0))  # vendor connectors are feeds
    ranked = postings.withColumn("_rank", rank)
    best = ranked.groupBy("board_url").agg(F.min("_rank").alias("_best")).hint("merge")
    return ranked.join(best, "board_url").where("_rank = _best").drop("_rank", "_best")


def scrape(boards: DataFrame, fetches: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """All postings of boards (``board_url, company, ats, final_url, html``), each board by its first strategy that finds any.

    What each group of connectors finds is written to the shared folder, one
    after the other, and the choice reads that: the choice and what follows it
    use the postings several times, and a plan that holds all connectors as
    often is more than the driver's memory takes, however small the tables.
    """
    vendors = [workday_postings(boards, fetches), comeet_postings(boards, fetches), njoyn_postings(boards)]
    groups = [feed_postings(boards, fetches), reduce(DataFrame.unionByName, vendors), wordpress_postings(boards, fetches), sitemap_postings(boards, fetches), link_postings(boards).select(*JOBS)]
    if rendered is not None:
        groups.append(link_postings(rendered, via="rendered").select(*JOBS))
    return first_strategy(reduce(DataFrame.unionByName, [materialise(g, "scraped") for g in groups]))


def pages_once(fetches: DataFrame) -> DataFrame:
    """One fetch for each request: a successful one before others, of several the one whose body has the least digest."""
    order = Window.partitionBy("url", "method", "request_body").orderBy(F.desc(F.coalesce(F.col("status") == 200, F.lit(False))), F.desc_nulls_last("status"), F.md5("body"))
    return fetches.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


#: Connectors of single vendors by platform.
VENDOR_CONNECTORS = {"workday": workday_postings, "comeet": comeet_postings, "njoyn": njoyn_postings}
