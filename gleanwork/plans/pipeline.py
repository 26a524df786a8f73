"""Contiguous slices of the posting pipeline, stage by stage."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.operators.details import read_details
from gleanwork.operators.filters import dedupe, first_filter, second_filter
from gleanwork.operators.store import insert_ignore, without_done
from gleanwork.schemas import JOB_DATA, POSTINGS_DETAILED, POSTINGS_RAW
from gleanwork.sources.connectors import scrape
from gleanwork.sources.sinks import write_table

STAGES = ("scrape", "filter", "detail", "refilter", "store")


@dataclass
class Settings:
    """Where tables lie and what to look for; ``fetches`` stands for the network."""

    folder: str
    keywords: Sequence[str] = ()
    blacklist: Sequence[str] = ()
    boards: DataFrame | None = None
    fetches: DataFrame | None = None
    on_progress: Callable[[str], None] | None = None
    results: dict[str, dict] = field(default_factory=dict)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"


def stage_slice(first: str, last: str) -> tuple[str, ...]:
    for name in (first, last):
        if name not in STAGES:
            raise ValueError(f"no stage {name!r}; stages are {', '.join(STAGES)}")
    a, b = STAGES.index(first), STAGES.index(last)
    if a > b:
        raise ValueError(f"{first!r} comes after {last!r}")
    return STAGES[a : b + 1]


def _scrape(spark: SparkSession, s: Settings) -> dict:
    postings = scrape(s.boards, s.fetches).join(s.boards.select(F.col("board_url"), "ats").dropDuplicates(["board_url"]).hint("merge"), "board_url")
    return write_table(dedupe(postings, order=("board_url", "url")), s.path("jobs"), POSTINGS_RAW.fieldNames())


def _filter(spark: SparkSession, s: Settings) -> dict:
    rows = spark.read.schema(POSTINGS_RAW).parquet(s.path("jobs"))
    return write_table(first_filter(rows, s.keywords, s.blacklist), s.path("first_filtered"))


def _detail(spark: SparkSession, s: Settings) -> dict:
    from gleanwork.streaming.incremental import existing

    rows = spark.read.schema(POSTINGS_RAW).parquet(s.path("first_filtered"))
    todo = without_done(rows, existing(spark, s.path("detailed"), POSTINGS_DETAILED))
    return write_table(read_details(todo, s.fetches), s.path("detailed"), POSTINGS_DETAILED.fieldNames(), mode="append")


def _refilter(spark: SparkSession, s: Settings) -> dict:
    rows = spark.read.schema(POSTINGS_DETAILED).parquet(s.path("detailed"))
    return write_table(second_filter(rows, s.keywords, s.blacklist), s.path("filtered"))


def _store(spark: SparkSession, s: Settings) -> dict:
    from gleanwork.streaming.incremental import existing

    rows = spark.read.parquet(s.path("filtered")).withColumn("pos", F.xxhash64("url"))
    stored = existing(spark, s.path("job_data"), JOB_DATA)
    fresh = insert_ignore(stored, rows, ["pos", "url"]).withColumn("timestamp", F.current_timestamp().cast("timestamp_ntz"))
    return write_table(fresh, s.path("job_data"), JOB_DATA.fieldNames(), mode="append")


RUN = {"scrape": _scrape, "filter": _filter, "detail": _detail, "refilter": _refilter, "store": _store}


def run(spark: SparkSession, settings: Settings, from_stage: str = STAGES[0], to_stage: str = STAGES[-1]) -> dict[str, dict]:
    """Run the stages from one to another; returns each stage's counts."""
    for name in stage_slice(from_stage, to_stage):
        settings.results[name] = RUN[name](spark, settings)
        if settings.on_progress:
            settings.on_progress(f"{name}: {settings.results[name]}")
    return settings.results
