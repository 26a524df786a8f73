"""The two filter passes over postings, the per-company cap, and first-wins dedupe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.functions.text import is_blank, keyword_hits, matches_any
from gleanwork.functions.urls import norm_url, title_from_url

# --- fixed values: thresholds of both filters ---
MIN_HITS = 2
MIN_HITS_DETAILED, MIN_HITS_INCOMPLETE = 5, 3
MAX_UNJUDGED_PER_COMPANY = 300
# --- end of fixed values ---


def recover_titles(postings: DataFrame) -> DataFrame:
    """Blank titles are read from the URL; a null URL gives ""."""
    return postings.withColumn("title", F.when(is_blank("title"), title_from_url("url")).otherwise(F.col("title")))


def capped_per_group(rows: DataFrame, group: str, key: str, most: int, exempt: Column | None = None) -> DataFrame:
    """At most ``most`` rows of each group, an even choice that every run repeats; a null group is dropped.

    Ranked by md5 of the key: a group's window keeps only the first ``most``
    rows of each task before the shuffle, so a huge company costs no more than
    its cap in each task. ``exempt`` rows stay and do not count; they are never
    moved, for which the input is scanned twice.
    """
    free = F.coalesce(exempt, F.lit(False)) if exempt is not None else F.lit(False)
    order = Window.partitionBy(group).orderBy(F.md5(F.coalesce(F.col(key), F.lit(""))), key)
    capped = rows.where(~free & F.col(group).isNotNull()).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_rank")
    return capped if exempt is None else rows.where(free).unionByName(capped)


def first_filter(postings: DataFrame, keywords: Sequence[str], blacklist: Sequence[str], min_hits: int = MIN_HITS, most_unjudged: int = MAX_UNJUDGED_PER_COMPANY) -> DataFrame:
    """Postings worth fetching: keyword hits in title and URL, or no title to judge by (capped per company).

    Blacklisted rows go first. Without keywords all others stay.
    """
    rows = recover_titles(postings).where(~matches_any(["title", "url"], blacklist))
    if not keywords:
        return rows
    rows = rows.withColumn("_judged", keyword_hits(["title", "url"], keywords) >= min_hits).where(F.col("_judged") | is_blank("title"))
    return capped_per_group(rows, "company", "url", most_unjudged, F.col("_judged")).drop("_judged")


def detail_threshold() -> Column:
    return F.when(is_blank("title") | is_blank("url"), F.lit(MIN_HITS_INCOMPLETE)).otherwise(F.lit(MIN_HITS_DETAILED))


def second_filter(postings: DataFrame, keywords: Sequence[str], blacklist: Sequence[str]) -> DataFrame:
    """Postings whose fetched text has enough keyword hits; adds ``keyword_hits``.

    Rows without a description go. Without keywords the others all stay,
    blacklisted ones too, and ``keyword_hits`` is null.
    """
    rows = postings.where(~is_blank("description"))
    if not keywords:
        return rows.withColumn("keyword_hits", F.lit(None).cast("long"))
    columns = ["title", "url", "description"]
    rows = rows.where(~matches_any(columns, blacklist)).withColumn("keyword_hits", keyword_hits(columns, keywords))
    return rows.where(F.col("keyword_hits") >= detail_threshold())


def dedupe(postings: DataFrame, url: str = "url", order: Sequence[str] = ("pos",)) -> DataFrame:
    """First row of each normalised URL by ``order``; rows without URL all stay, where they are."""
    window = Window.partitionBy("_key").orderBy(*order)
    keyed = postings.where(F.col(url).isNotNull()).withColumn("_key", norm_url(url))
    first = keyed.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n", "_key")
    return first.unionByName(postings.where(F.col(url).isNull()))
