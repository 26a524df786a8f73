"""Distinct counts that add up: a stored sketch for each day, united for any span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a sketch, as a power of two; its relative standard error is about 1.04 / sqrt(2 ** LOG_K).
LOG_K = 14


def daily_sketches(rows: DataFrame, time: str, *columns: str) -> DataFrame:
    """``day`` and a sketch of the distinct values of each column, as ``sketch_<column>``: a few kilobytes a day, whatever the rows."""
    day = F.to_date(time).alias("day")
    return rows.groupBy(day).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), LOG_K).alias(f"sketch_{c}") for c in columns])


def distinct_in(sketches: DataFrame, column: str, *groups: Column) -> DataFrame:
    """Estimated distinct values of a column over the days of each group (``n_<column>``), from stored sketches alone."""
    united = F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{column}"))
    return sketches.groupBy(*groups).agg(united.alias(f"n_{column}"))
