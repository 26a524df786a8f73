"""HTTP responses as a table: a Python data source, and what is decided from its columns."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gleanwork.functions.batches import row_udf
from gleanwork.functions.types import STRING

# --- fixed values ---
TEXTUAL = ("text/", "application/xhtml", "application/xml", "application/json", "application/rss", "application/ld+json")
RETRY_STATUSES = (429, 500, 502, 503, 504)
TRIES, BACKOFF, DELAY, TIMEOUT = 3, 0.5, 0.2, 20
MAX_BYTES, FEED_MAX_BYTES = 2_000_000, 20_000_000
# --- end of fixed values ---

SCHEMA = "url string, method string, request_body string, status int, content_type string, final_url string, redirect_chain array<string>, body string, error string"


def is_textual(content_type: Column) -> Column:
    """Whether a body of this type is text; no type at all is taken as text."""
    low = F.lower(F.coalesce(content_type, F.lit("")))
    out = low == ""
    for kind in TEXTUAL:
        out = out | F.contains(low, F.lit(kind))
    return out


def charset_of(content_type: Column) -> Column:
    """Declared charset, else UTF-8."""
    found = F.regexp_extract(F.lower(F.coalesce(content_type, F.lit(""))), r"charset\s*=\s*[\"']?([\w.:-]+)", 1)
    return F.when(found == "", F.lit("utf-8")).otherwise(found)


def decoded_body(raw: bytes, content_type: str | None) -> str:
    """Text of a body: the declared charset, else UTF-8; bad bytes are replaced."""
    charset = "utf-8"
    for part in (content_type or "").split(";")[1:]:
        name, _, value = part.strip().partition("=")
        if name.lower() == "charset" and value:
            charset = value.strip("\"'")
    try:
        return raw.decode(charset, "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


@row_udf(STRING)
def text_of_bytes(body: bytes | None, content_type: str | None) -> str | None:
    """Bodies kept as bytes, decoded as ``decoded_body`` does; null stays null."""
    return None if body is None else decoded_body(body, content_type)


def usable(fetches: DataFrame) -> DataFrame:
    """Fetches with a text that can be read: status 200, textual, not empty."""
    return fetches.where((F.col("status") == 200) & F.col("error").isNull() & is_textual(F.col("content_type")) & (F.coalesce("body", F.lit("")) != ""))


def json_body(fetches: DataFrame) -> DataFrame:
    """Add ``json`` (variant; null for bodies that do not parse as one whole value).

    The parser stops after the first value, so the body is read as the first of
    two items, the second a mark: what follows the value leaves the mark out of place.
    """
    mark = "end of body"
    pair = F.try_parse_json(F.concat(F.lit("["), F.col("body"), F.lit(f', "{mark}"]')))
    whole = F.try_variant_get(pair, "$[1]", "string") == mark
    return fetches.withColumn("json", F.when(whole, F.try_variant_get(pair, "$[0]", "variant")))


class _Redirects(urllib.request.HTTPRedirectHandler):
    def __init__(self) -> None:
        self.chain: list[str] = []

    def redirect_request(self, req, fp, code, msg, headers, newurl):  # noqa: ANN001, ANN201, PLR0913
        self.chain.append(newurl)
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def fetch(url: str, method: str = "GET", request_body: str | None = None, max_bytes: int = MAX_BYTES, timeout: float = TIMEOUT) -> tuple:
    """One row of the fetch table. Errors become data; nothing is raised."""
    chain = [url]
    status, error, kind, final, body = None, None, None, url, None
    for attempt in range(TRIES):
        redirects = _Redirects()
        error = None
        try:
            data = request_body.encode() if request_body else None
            headers = {"User-Agent": "gleanwork/0.1", **({"Content-Type": "application/json"} if data else {})}
            request = urllib.request.Request(url, data, headers, method=method)  # noqa: S310
            with urllib.request.build_opener(redirects).open(request, timeout=timeout) as response:
                status, kind, final = response.status, response.headers.get("Content-Type"), response.url
                chain = [url, *redirects.chain]
                low = (kind or "").lower()
                if not low or any(x in low for x in TEXTUAL):
                    body = decoded_body(response.read(max_bytes), kind)
            break
        except urllib.error.HTTPError as e:
            status, kind, final = e.code, e.headers.get("Content-Type"), e.url or url
            if e.code not in RETRY_STATUSES:
                break
        except (OSError, ValueError) as e:
            error = type(getattr(e, "reason", e)).__name__ if not isinstance(getattr(e, "reason", None), str) else type(e).__name__
            if isinstance(e, ValueError):
                break
        if attempt + 1 < TRIES:
            time.sleep(BACKOFF * 2**attempt)
    return url, method, request_body, status, kind, final, chain, body, error


class _Part(InputPartition):
    def __init__(self, requests: list[tuple]) -> None:
        self.requests = requests


class HttpPages(DataSource):
    """``spark.read.format("http_pages").option("urls", "...\\n...")``: one row for each URL.

    URLs of one host share a partition and keep a delay between requests, so a
    host sees one client at a time; hosts are read in parallel.
    """

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):  # noqa: ANN001, ANN201
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        #: (url, method, request body) by the lines of two options: URLs, or JSON objects with these names.
        self.requests = [(u.strip(), "GET", None) for u in options.get("urls", "").split("\n") if u.strip()]
        posts = [json.loads(x) for x in options.get("requests", "").split("\n") if x.strip()]
        self.requests += [(x["url"], x.get("method", "GET").upper(), x.get("request_body")) for x in posts]
        self.delay = float(options.get("delay", DELAY))
        self.max_bytes = int(options.get("max_bytes", MAX_BYTES))
        self.timeout = float(options.get("timeout", TIMEOUT))

    def partitions(self) -> list[InputPartition]:
        by_host: dict[str, list[tuple]] = {}
        for x in dict.fromkeys(self.requests):
            by_host.setdefault(x[0].split("/")[2] if x[0].count("/") >= 2 else x[0], []).append(x)
        return [_Part(x) for x in by_host.values()] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for i, (url, method, body) in enumerate(partition.requests):
            if i:
                time.sleep(self.delay)
            yield fetch(url, method, body, self.max_bytes, self.timeout)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpPages)


def fetch_table(urls: DataFrame, column: str = "url", max_bytes: int = MAX_BYTES, delay: float = DELAY) -> DataFrame:
    """Fetch the distinct URLs of a frame, each host's in one task; a distributed form of the data source."""
    return fetch_requests(urls.select(F.col(column).alias("url")), max_bytes, delay)


def fetch_requests(requests: DataFrame, max_bytes: int = MAX_BYTES, delay: float = DELAY) -> DataFrame:
    """Fetch the distinct requests of a frame (``url``, and if there ``method`` and ``request_body``), each host's in one task."""
    from gleanwork.functions.urls import host_of

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            rows = []
            for url, method, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows.append(fetch(url, method, body, max_bytes))
                time.sleep(delay)
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            kinds = {"status": pa.int32(), "redirect_chain": pa.list_(pa.string())}
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], kinds.get(n, pa.string())) for i, n in enumerate(names)})

    has = set(requests.columns)
    method = F.upper(F.coalesce("method", F.lit("GET"))) if "method" in has else F.lit("GET")
    body = F.col("request_body") if "request_body" in has else F.lit(None).cast("string")
    wanted = requests.select("url", method.alias("method"), body.alias("request_body")).where("url is not null").distinct()
    return wanted.repartition(host_of("url")).mapInArrow(run, SCHEMA)
