"""Joins and writes over stored postings, their grades and generated documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.functions.text import interval_of, strip
from gleanwork.operators.ranges import numbered
from gleanwork.sources.shared import materialise


def since(timestamp: str, window: str, now: Column | None = None) -> Column:
    """Whether a time lies in the window that ends now (``-24 hours``); an invalid window holds nothing."""
    try:
        span = interval_of(window)
    except ValueError:
        return F.lit(False)
    now = now if now is not None else F.to_timestamp_ntz(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.col(timestamp) >= now + F.expr(span)


def not_in(rows: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Null-aware anti join, as SQL's NOT IN: one null in ``other`` leaves no row, and null keys go unless ``other`` is empty.

    Written as a plain anti join and two counts, so that the planner chooses
    by size how to join; NOT IN itself broadcasts ``other`` whatever its size.
    """
    return rows.sparkSession.sql(
        f"""SELECT r.* FROM {{rows}} r LEFT ANTI JOIN {{other}} o ON r.`{key}` = o.`{other_key}`
        WHERE (SELECT count_if(`{other_key}` IS NULL) FROM {{other}}) = 0 AND (r.`{key}` IS NOT NULL OR (SELECT count(*) FROM {{other}}) = 0)""",
        rows=rows, other=other,
    )


def limited(rows: DataFrame, limit: int) -> DataFrame:
    """First rows of an ordered frame; 0 means all."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    return rows.limit(limit) if limit else rows


def pending(jobs: DataFrame, analyses: DataFrame, window: str = "-24 hours", now: Column | None = None) -> DataFrame:
    """Postings of the window without a grade."""
    return not_in(jobs.where(since("timestamp", window, now)), "id", analyses, "job_id")


def jobs_to_analyse(jobs: DataFrame, analyses: DataFrame, window: str = "-24 hours", limit: int = 0, now: Column | None = None) -> DataFrame:
    return limited(pending(jobs, analyses, window, now).select("id", "company", "title", "description").orderBy("id"), limit)


def count_to_analyse(jobs: DataFrame, analyses: DataFrame, window: str = "-24 hours", now: Column | None = None) -> DataFrame:
    return pending(jobs, analyses, window, now).agg(F.count("*").alias("pending"))


def job_state(jobs: DataFrame, analyses: DataFrame) -> DataFrame:
    """``id, is_graded`` of each posting: whether it is stored is being a row, whether graded the flag."""
    graded = analyses.select(F.col("job_id").alias("id")).where("id is not null").distinct().withColumn("is_graded", F.lit(True))
    return jobs.select("id").join(graded, "id", "left").select("id", F.coalesce("is_graded", F.lit(False)).alias("is_graded"))


def by_url(jobs: DataFrame, url: str) -> DataFrame:
    return jobs.where(F.col("url") == url)


def by_job(rows: DataFrame, job_id: int) -> DataFrame:
    return rows.where(F.col("job_id") == job_id)


def job_urls(jobs: DataFrame) -> DataFrame:
    return jobs.select("url").distinct()


def graded(jobs: DataFrame, analyses: DataFrame) -> DataFrame:
    """Grades with their postings, best first."""
    joined = analyses.join(jobs, analyses["job_id"] == jobs["id"])
    return joined.select(
        jobs["id"], "adequation_grade", "company", "title", "place", "url", "ai_model", "depth_analysis", "description", "timestamp"
    ).orderBy(F.desc("adequation_grade"), "id")


def jobs_for_cv(jobs: DataFrame, analyses: DataFrame, cvs: DataFrame, min_grade: int = 0) -> DataFrame:
    """Graded postings without a generated document, best first."""
    open_jobs = not_in(jobs, "id", cvs, "job_id")
    good = analyses.where(F.col("adequation_grade") >= min_grade)
    joined = good.join(open_jobs, good["job_id"] == open_jobs["id"])
    return joined.select(open_jobs["id"], "adequation_grade", "company", "title", "place", "url").orderBy(F.desc("adequation_grade"), "id")


def generated(cvs: DataFrame, jobs: DataFrame, analyses: DataFrame, zone: str = "UTC") -> DataFrame:
    """Generated documents, newest first, then best grade; times in ``zone``."""
    c, j, a = cvs.alias("c"), jobs.alias("j"), analyses.alias("a")
    joined = c.join(j, F.col("j.id") == F.col("c.job_id")).join(a, F.col("a.id") == F.col("c.ai_analysis_id"))
    rows = joined.select(
        F.col("c.id").alias("id"), "j.title", "j.company", "a.adequation_grade", "c.locale", "c.cv", "j.url", F.col("c.timestamp").alias("_at"),
        F.from_utc_timestamp(F.col("c.timestamp").cast("timestamp"), zone).alias("timestamp"),
    )
    return rows.orderBy(F.desc("_at"), F.desc("adequation_grade"), "id").drop("_at")


def for_generation(jobs: DataFrame, analyses: DataFrame, job_id: int) -> DataFrame:
    job = jobs.where(F.col("id") == job_id).select(F.col("id").alias("_id"), "description")
    return job.join(analyses, F.col("_id") == F.col("job_id")).select("description", F.col("id").alias("analysis_id"), "depth_analysis")


def new_rows(existing: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """Rows of ``batch`` whose URL is new: the first of equal URLs by ``order``, and all without URL."""
    window = Window.partitionBy("url").orderBy(*order)
    with_url = batch.where("url is not null").withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")
    return with_url.join(existing.select("url").where("url is not null").distinct().hint("merge"), "url", "left_anti").unionByName(batch.where("url is null"))


def insert_ignore(existing: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """Rows of ``batch`` whose URL is new, with ids after the existing ones.

    The first of equal URLs in the batch counts; rows without URL never
    conflict. Ids follow ``order``, whose first column is a number. The new
    rows are found once and written to the shared folder; numbers are given to
    what was written.
    """
    fresh = materialise(new_rows(existing, batch, order), "new-rows")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return numbered(fresh, order, "id", top + 1)


def insert_counts(existing: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """One row: how many rows of the batch are new, and how many are skipped."""
    fresh = new_rows(existing, batch, order).agg(F.count("*").alias("inserted"))
    return fresh.join(batch.agg(F.count("*").alias("_all"))).select("inserted", (F.col("_all") - F.col("inserted")).alias("skipped"))


def without_done(rows: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key is not done; blank keys never count as done. What is done grows without end, so it is never broadcast."""
    return rows.join(done.select(key).where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).distinct().hint("merge"), key, "left_anti")


def funnel(kept: DataFrame, stored: DataFrame, fetched: DataFrame, key: str = "url") -> DataFrame:
    """One row: kept rows, those not stored, and those of them not fetched either."""
    flag = lambda df, name: df.select(key).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(1))
    marked = kept.select(key).join(flag(stored, "_stored"), key, "left").join(flag(fetched, "_fetched"), key, "left")
    todo = F.col("_stored").isNull()
    return marked.agg(F.count("*").alias("kept"), F.count_if(todo).alias("todo"), F.count_if(todo & F.col("_fetched").isNull()).alias("fresh"))


def check_analyses(incoming: DataFrame, jobs: DataFrame, analyses: DataFrame) -> DataFrame:
    """Each incoming grade with ``rejected``: null, or why it is not stored.

    A grade lies within 0 to 100, its text is not blank (and is stored
    stripped), its posting exists and has no grade yet; of several for one
    posting the first by ``id`` counts.
    """
    known = jobs.select(F.col("id").alias("job_id")).distinct().withColumn("_known", F.lit(True))
    have = analyses.select("job_id").where("job_id is not null").distinct().withColumn("_graded", F.lit(True))
    rows = incoming.withColumn("depth_analysis", strip("depth_analysis")).join(known, "job_id", "left").join(have, "job_id", "left")
    reason = (
        F.when(~F.coalesce(F.col("adequation_grade").between(0, 100), F.lit(False)), "grade out of range")
        .when(F.coalesce("depth_analysis", F.lit("")) == "", "blank analysis")
        .when(F.col("_known").isNull(), "unknown job")
        .when(F.col("_graded"), "already graded")
    )
    rows = rows.withColumn("rejected", reason)
    first = Window.partitionBy("job_id", F.col("rejected").isNull()).orderBy("id")
    again = F.col("rejected").isNull() & (F.row_number().over(first) > 1)
    return rows.withColumn("rejected", F.when(again, "already graded").otherwise(F.col("rejected"))).drop("_known", "_graded")


def migrated(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """The rows with missing columns added and nulls of those columns filled; running it again changes nothing."""
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    return rows


def reindexed(rows: DataFrame, names: list[str]) -> DataFrame:
    """Exactly these columns; missing ones and nulls are ""."""
    return rows.select(*[(F.coalesce(F.col(n).cast("string"), F.lit("")) if n in rows.columns else F.lit("")).alias(n) for n in names])
