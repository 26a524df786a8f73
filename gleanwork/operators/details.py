"""Posting details from fetched pages: the extraction ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions import html as H
from gleanwork.functions import jsonx as J
from gleanwork.functions.urls import workday_api


def _present(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def read_details(rows: DataFrame, fetches: DataFrame) -> DataFrame:
    """Details of ``rows`` (``company, title, url, place, ats``) from ``fetches``; one output row for each.

    Workday postings come from their JSON endpoint. Other pages give their
    JSON-LD posting, else the main part, else the body without furniture. What
    the page lacks is taken from the row. A page that could not be read gives
    ``via`` none and no description; nothing fails.
    """
    ok = fetches.where("status = 200").select(F.col("url").alias("_url"), "body").hint("merge")  # growing: not through the driver
    rows = rows.withColumn("_workday", F.coalesce(F.col("ats") == "workday", F.lit(False)))
    rows = rows.withColumn("_source", F.when(F.col("_workday"), workday_api("url")).otherwise(F.col("url")))
    met = rows.join(ok, F.col("_source") == F.col("_url"), "left")
    page = met.withColumn("_d", H.extract_detail(F.when(F.col("_workday"), F.lit(None).cast("string")).otherwise(F.col("body"))))
    info = F.when(F.col("_workday"), J.json_dig("body", F.lit("jobPostingInfo")))
    page = page.withColumn("_info", info)
    text = H.html_to_text(F.get_json_object("_info", "$.jobDescription"))
    page = page.withColumn("_w", F.nullif(text, F.lit("")))
    via = F.when(F.col("body").isNull(), "none").when(F.col("_w").isNotNull(), "workday").when(F.col("_workday"), "none").when(F.col("_d.jsonld").isNotNull(), "jsonld")
    via = via.when(F.coalesce("_d.main", F.lit("")) != "", "main").when(F.coalesce("_d.body", F.lit("")) != "", "body").otherwise("none")
    page = page.withColumn("_via", via)
    by = lambda **names: F.coalesce(*[F.when(F.col("_via") == k, v) for k, v in names.items()])
    title = by(workday=J.json_first_string("_info", F.lit("title")), jsonld=F.col("_d.jsonld.title"), main=F.col("_d.page_title"), body=F.col("_d.page_title"))
    company = by(jsonld=F.col("_d.jsonld.company"))
    place = by(workday=J.json_first_string("_info", F.lit("location")), jsonld=F.col("_d.jsonld.place"))
    description = by(workday=F.col("_w"), jsonld=F.col("_d.jsonld.description"), main=F.col("_d.main"), body=F.col("_d.body"))
    page = page.withColumn("_t", title).withColumn("_c", company).withColumn("_p", place).withColumn("_text", F.coalesce(description, F.lit("")))

    def pick(found: str, own: str) -> Column:
        return H.html_unescape_twice(F.coalesce(_present(found), _present(own), F.lit("")))

    return page.select(
        pick("_c", "company").alias("company"), pick("_t", "title").alias("title"), F.col("_text").alias("description"), "url",
        F.nullif(pick("_p", "place"), F.lit("")).alias("place"), F.col("_via").alias("via"), "ats",
    )
