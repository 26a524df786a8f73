"""Resumable stages: streams over growing tables that append what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.operators.store import without_done


def existing(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, or no rows if it has not been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def resume(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], key: str = "url") -> None:
    """Process what is new in the Parquet folder ``source`` and append it to ``target``, once.

    The checkpoint remembers files; the anti join on ``key`` remembers rows,
    so a batch that is repeated after a failure adds nothing twice. Rows whose
    key is blank are always processed.
    """

    def append(batch: DataFrame, epoch: int) -> None:
        rows = batch.dropDuplicates([key]) if key in batch.columns else batch
        done = existing(batch.sparkSession, target, T.StructType([schema[key]]))
        work(without_done(rows, done, key)).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(append)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def deduplicated_stream(stream: DataFrame, key: str, time: str, window: str = "24 hours") -> DataFrame:
    """First row of each key; the state of a key is kept for the look-back window."""
    return stream.withWatermark(time, window).dropDuplicatesWithinWatermark([key])


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drain a stream into a Parquet folder and read that."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def recent(rows: DataFrame, time: str, now: str, window: str) -> DataFrame:
    """Rows of the window that ends at ``now``."""
    from gleanwork.operators.store import since

    return rows.where(since(time, window, F.lit(now).cast("timestamp_ntz")))
