"""Sinks: overwrite and append as Parquet or CSV, with counts of what passed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_table(rows: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "overwrite", kind: str = "parquet") -> dict:
    """Write the named columns (others are ignored); returns ``{"rows": n}`` observed in the same pass."""
    seen = Observation()
    rows = (rows.select(*columns) if columns else rows).observe(seen, F.count("*").alias("rows"))
    writer = rows.write.mode(mode)
    writer.option("header", True).option("escape", '"').csv(path) if kind == "csv" else writer.parquet(path)
    return dict(seen.get)


def split_outcomes(results: DataFrame, path: str, misses_path: str) -> dict:
    """Postings and misses of one scrape, from rows with ``error``: both are written from one stored result."""
    from gleanwork.schemas import MISSES, POSTINGS_RAW

    held = results.persist()
    try:
        jobs = write_table(held.where("error is null and url is not null"), path, POSTINGS_RAW.fieldNames())
        missed = held.where("error is not null").withColumn("reason", F.col("error")).withColumn("url", F.coalesce("board_url", "url"))
        return {"jobs": jobs["rows"], "failed": write_table(missed, misses_path, MISSES.fieldNames())["rows"]}
    finally:
        held.unpersist()
