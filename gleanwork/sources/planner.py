"""Requests that the connectors still need, and rounds of fetching them.

Connectors read a table of fetches. From that table alone follows what they
would ask next: a feed's first page and those up to its stated total, the next
POST page of a Workday board, a Comeet board's one request, WordPress types and
pages, the next place of a sitemap search and the postings it lists. So
fetching is a loop of plan, fetch and append, which ends when nothing is open
and goes on where it was left.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.sources import connectors as C
from gleanwork.sources.fetches import SCHEMA, fetch_requests

REQUEST = ["board_url", "url", "method", "request_body"]


def _gets(rows: DataFrame, url: str) -> DataFrame:
    return rows.select("board_url", F.col(url).alias("url"), F.lit("GET").alias("method"), F.lit(None).cast("string").alias("request_body"))


def _open(requests: DataFrame, fetches: DataFrame) -> DataFrame:
    """Requests that ``fetches`` does not hold, with whatever result."""
    done = fetches.select(F.col("url").alias("_u"), F.upper(F.coalesce("method", F.lit("GET"))).alias("_m"), F.coalesce("request_body", F.lit("")).alias("_b")).distinct()
    same = (F.col("url") == F.col("_u")) & (F.col("method") == F.col("_m")) & (F.coalesce("request_body", F.lit("")) == F.col("_b"))
    return requests.where("url is not null").join(done, same, "left_anti").select(*REQUEST)


def _without(boards: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(lambda b, o: b.join(o.select("board_url").distinct(), "board_url", "left_anti"), others, boards)


def workday_requests(boards: DataFrame, fetches: DataFrame) -> DataFrame:
    """The page after the last one of each board, unless that is short or the last allowed."""
    pages = C.workday_pages(boards, fetches).select("board_url", "offset", F.size("items").alias("_n"))
    last = pages.groupBy("board_url").agg(F.max("offset").alias("_last"), F.max_by("_n", "offset").alias("_n"))
    rows = C.workday_endpoints(boards).select("board_url", "endpoint").join(last, "board_url", "left")
    rows = rows.withColumn("_next", F.coalesce(F.col("_last") + C.WORKDAY_PAGE, F.lit(0))).where(F.col("_n").isNull() | (F.col("_n") >= C.WORKDAY_PAGE))
    rows = rows.where(F.col("_next") < C.WORKDAY_PAGE * C.WORKDAY_PAGES)
    body = F.format_string('{"appliedFacets": {}, "limit": %d, "offset": %d, "searchText": ""}', F.lit(C.WORKDAY_PAGE), F.col("_next"))
    return rows.select("board_url", F.col("endpoint").alias("url"), F.lit("POST").alias("method"), body.alias("request_body"))


def platform_requests(boards: DataFrame, fetches: DataFrame) -> DataFrame:
    """Of boards whose platform has an interface: feeds, Workday, Comeet."""
    feeds = [_gets(C.feed_page_urls(C.feed_requests(boards, f), fetches, f), "_page") for f in C.FEEDS]
    return reduce(DataFrame.union, [*feeds, workday_requests(boards, fetches), _gets(C.comeet_endpoints(boards), "endpoint")])


def wordpress_requests(boards: DataFrame, fetches: DataFrame) -> DataFrame:
    """Types of WordPress boards, then one page after the other up to the first short one."""
    read = C.wordpress_read(boards, fetches).groupBy("board_url").agg(F.max("page").alias("_last"), F.max_by(F.size("items"), "page").alias("_n"))
    pages = C.wordpress_pages(boards, fetches).join(read, "board_url", "left")
    pages = pages.where((F.col("page") == F.coalesce(F.col("_last") + 1, F.lit(1))) & (F.col("_n").isNull() | (F.col("_n") >= C.WORDPRESS_PAGE)))
    return _gets(C.wordpress_types(boards), "endpoint").union(_gets(pages, "_page"))


def sitemap_requests(boards: DataFrame, fetches: DataFrame) -> DataFrame:
    """The next place where a board's sitemap may be; where it is found, the postings that are read for their titles."""
    found = C.sitemap_search(boards, fetches)
    details = found.where("sitemap is not null").select("board_url", F.explode(F.slice("jobs", 1, C.MAX_DETAIL)).alias("job"))
    return _gets(found.where("sitemap is null"), "next").union(_gets(details, "job"))


def _first(boards: DataFrame, fetches: DataFrame) -> DataFrame:
    return _open(platform_requests(boards, fetches), fetches)


def _unserved(boards: DataFrame, fetches: DataFrame) -> DataFrame:
    """Boards whose platform's interface gave no posting."""
    served = [f(boards, fetches).select("board_url") for f in (C.feed_postings, C.workday_postings, C.comeet_postings)]
    return _without(boards, *served, C.njoyn_postings(boards))


def _second(boards: DataFrame, fetches: DataFrame) -> DataFrame:
    return _open(wordpress_requests(boards, fetches), fetches)


def _third(boards: DataFrame, fetches: DataFrame) -> DataFrame:
    return _open(sitemap_requests(boards, fetches), fetches)


def planned_requests(boards: DataFrame, fetches: DataFrame) -> DataFrame:
    """``board_url, url, method, request_body`` of what is to be fetched next.

    ``boards`` has ``board_url, company, ats, final_url, html``. A board whose
    platform has an interface is tried by it first, then as WordPress, then by
    its sitemap; the next way is planned once the one before it has no open
    request and gave no posting. Failed fetches are not asked again.
    """
    first = _first(boards, fetches)
    rest = _without(_unserved(boards, fetches), first)
    second = _second(rest, fetches)
    third = _third(_without(rest, second, C.wordpress_postings(rest, fetches)), fetches)
    return first.union(second).union(third).dropDuplicates(["url", "method", "request_body"])


def gather(boards: DataFrame, path: str, fetch: Callable[[DataFrame], DataFrame] = fetch_requests, most_rounds: int = 1000) -> DataFrame:
    """Fetch in rounds into the Parquet table ``path`` until nothing is open; returns the table.

    One way after the other, as in ``planned_requests``: a round plans only
    the way that has open requests. Each round appends whole and plans from one
    reading of the table. A run that is broken off goes on with what the table
    has.
    """
    spark = boards.sparkSession
    read = lambda: spark.read.schema(SCHEMA).parquet(path)
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(path)

    def left(known: DataFrame, way: int) -> DataFrame:
        rest = _unserved(boards, known) if way else boards
        return _without(rest, C.wordpress_postings(rest, known)) if way > 1 else rest

    rounds, before = 0, read().count()
    for way, plan in enumerate((_first, _second, _third)):
        while rounds < most_rounds:
            known = read()
            fetch(plan(left(known, way), known)).write.mode("append").parquet(path)
            rounds, after = rounds + 1, read().count()
            if after == before:
                break
            before = after
    return read()
