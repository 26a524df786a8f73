"""The functions of this package under names for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gleanwork.functions import html as H
from gleanwork.functions import jsonx as J

#: SQL bodies; they are expanded into the query that uses them.
SQL = {
    "norm_url(url STRING) RETURNS STRING": "regexp_replace(split_part(url, '#', 1), '/+$', '')",
    "is_blank(x STRING) RETURNS BOOLEAN": r"coalesce(regexp_replace(x, '(?U)^\\s+|\\s+$', '') IN ('', 'nan'), true)",
    "host_of(url STRING) RETURNS STRING": r"regexp_replace(split_part(lower(regexp_replace(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1), '^.*@', '')), ':', 1), '\\.+$', '')",
    "keyword_hits(x STRING, pattern STRING) RETURNS BIGINT": "regexp_count(coalesce(x, ''), pattern)",
}
PYTHON = {"html_unescape": H.html_unescape, "html_to_text": H.html_to_text, "ascii_slug": J.ascii_slug, "json_walk_strings": J.json_strings, "json_first_string": J.json_first_string, "extract_page": H.extract_page, "html_table_rows": H.html_table_rows}


@F.udtf(returnType="pos long, url string, label string, card_title string")
class HtmlAnchors:
    def eval(self, html: str, base: str):  # noqa: ANN201
        nodes = (n for n in H.parse(html).walk() if n.tag == "a" and "href" in n.attrs)
        for i, n in enumerate(nodes):
            yield i, H.absolute(base or "", n.attrs["href"].strip()), n.text(" "), H.card_title(n)


@F.udtf(returnType="title string, company string, locality string, region string, description string")
class JsonPostings:
    def eval(self, text: str):  # noqa: ANN201
        for x in J.walk_postings(J.parsed(text)):
            at = "jobLocation.address."
            yield J.first_string(x.get("title")), J.first_string(J.dig(x, "hiringOrganization.name")), J.first_string(J.dig(x, at + "addressLocality")), J.first_string(J.dig(x, at + "addressRegion")), H.fragment_text(x.get("description"))


def register(spark: SparkSession) -> None:
    """Make all functions known to SQL of this session."""
    for head, body in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name, f in PYTHON.items():
        spark.udf.register(name, f)
    spark.udtf.register("html_anchors", HtmlAnchors)
    spark.udtf.register("json_jobpostings", JsonPostings)
