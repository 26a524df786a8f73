"""Boards whose search is over are spread in later rounds, and only bodies with scripts are walked as trees."""

from pyspark.sql import functions as F

from gleanwork.sources import connectors as C


def test_finished_boards_do_not_meet_by_null(spark):
    boards = spark.range(40).select(F.format_string("https://b%d.fr/careers", "id").alias("board_url"), F.lit("c").alias("company"))
    locs = "".join(f"<loc>https://x.fr/jobs/{i}00-dev</loc>" for i in range(1, 4))
    fetches = spark.range(40).select(F.format_string("https://b%d.fr/sitemap.xml", "id").alias("url"), F.lit(200).alias("status"), F.lit(locs).alias("body"))
    found = C.sitemap_search(boards, fetches)
    assert [(len(r.jobs), r.sitemap) for r in found.orderBy("board_url").limit(2).collect()] == [(3, "https://b0.fr/sitemap.xml"), (3, "https://b1.fr/sitemap.xml")]
    text = found._jdf.queryExecution().analyzed().toString()
    joins = [line for line in text.splitlines() if "Join LeftOuter" in line]
    assert len(joins) == C.SITEMAP_REQUESTS + 1
    assert all("_key" in line for line in joins)
    assert [r.jobs for r in C.sitemap_search(boards, fetches.limit(0)).limit(1).collect()] == [[]]
