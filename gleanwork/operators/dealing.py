"""Dealing rows to tasks that stay the same size however large the table is."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Sorted and summed, so many slim rows take some 150 MB of a task.
ROWS_PER_TASK = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of ``rows`` rows, by hash of ``keys``: about ``ROWS_PER_TASK`` for each task, one task for each core at least.

    The session's number of shuffle partitions is fixed, so its tasks would
    grow with the table. Windows and groups by these keys, or by more, follow
    without a further exchange. Rows of one key stay together.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)), *keys)
