"""Why a board gave no postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions.urls import JOB_URL
from gleanwork.sources.fetches import is_textual

# --- fixed values ---
SPA_MARKERS = ('id="root"', "id='root'", 'id="app"', "id='app'", 'id="__next"', "id='__next'", "__NEXT_DATA__", "__INITIAL_STATE__", "__NUXT__")
FEW_ANCHORS, MANY_SCRIPTS = 15, 10
# --- end of fixed values ---

ANCHOR = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))[^>]*>"


def page_shape(html: Column) -> dict[str, Column]:
    """``anchors, scripts, marker, job_links`` of a page by patterns, without a tree."""
    found = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0))
    hrefs = F.transform(found, lambda a: F.concat(*[F.regexp_extract(a, ANCHOR, i) for i in (1, 2, 3)]))
    marker = F.coalesce(*[F.when(F.contains(html, F.lit(m)), F.lit(m)) for m in SPA_MARKERS])
    return {
        "anchors": F.size(found).cast("long"), "scripts": F.regexp_count(html, F.lit(r"(?i)<script[\s>]")).cast("long"), "marker": marker,
        "job_links": F.exists(hrefs, lambda u: F.rlike(u, F.lit(JOB_URL))),
    }


def diagnose(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``anchors, scripts, marker, job_links`` and the ``cause``.

    In this order: empty body; job-shaped links; a script-built page (marker,
    or few anchors and many scripts); no links; no job-shaped links.
    """
    text = F.coalesce(F.col(html), F.lit(""))
    rows = pages.withColumns(page_shape(text))
    cause = (
        F.when(F.rlike(text, F.lit(r"^(?U)\s*$")), "empty body")
        .when(F.col("job_links"), "job-shaped links present but no strategy read them")
        .when(F.col("marker").isNotNull() | ((F.col("anchors") < FEW_ANCHORS) & (F.col("scripts") >= MANY_SCRIPTS)), "likely javascript-rendered")
        .when(F.col("anchors") == 0, "no links on the page")
        .otherwise("no job-shaped links")
    )
    return rows.withColumn("cause", cause)


def diagnose_fetches(fetches: DataFrame) -> DataFrame:
    """Causes of fetched boards: request errors, statuses and content types before the page itself."""
    rows = diagnose(fetches, "body")
    cause = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("fetch failed: "), F.col("error")))
        .when(F.col("status") != 200, F.concat(F.lit("http "), F.col("status").cast("string")))
        .when(~is_textual(F.col("content_type")), F.concat(F.lit("non-textual body: "), F.col("content_type")))
        .otherwise(F.col("cause"))
    )
    return rows.withColumn("cause", cause)


def reason_text(cause: Column, anchors: Column, scripts: Column, marker: Column, redirect: Column, rendered: Column | None = None) -> Column:
    """Reason line for display; the columns stay the source of truth."""
    shape = F.concat(F.lit(" ("), anchors.cast("string"), F.lit(" anchors, "), scripts.cast("string"), F.lit(" scripts"), F.coalesce(F.concat(F.lit(", "), marker), F.lit("")), F.lit(")"))
    notes = [F.when(redirect.isNotNull(), F.concat(F.lit("redirected to "), redirect))]
    if rendered is not None:
        notes.append(F.when(rendered, F.lit("renderer ran and still found nothing")))
    note = F.concat_ws("; ", *notes)
    own_shape = F.when(F.rlike(cause, F.lit("^(job-shaped|likely|no links|no job-shaped)")), shape).otherwise(F.lit(""))
    return F.concat(cause, own_shape, F.when(note != "", F.concat(F.lit(" ("), note, F.lit(")"))).otherwise(F.lit("")))
