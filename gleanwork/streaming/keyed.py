"""First rows of keys in a stream, remembered in keyed state instead of looked up in the target."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleanwork.operators.ranges import numbered
from gleanwork.sources.shared import materialise
from gleanwork.sources.versioned import VersionedTable

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _least(rows: pd.DataFrame, by: list[str]) -> int:
    """Place of the row that a stable sort puts first, nulls last; a key's few rows are not worth a sort of frames."""
    if len(rows) == 1 or not by:
        return 0
    keys = list(zip(*([(True, None) if null else (False, x) for null, x in zip(rows[c].isna().tolist(), rows[c].tolist(), strict=True)] for c in by), strict=True))
    return min(range(len(keys)), key=keys.__getitem__)


def first_of_key(stream: DataFrame, key: str, *order: str, keep_ms: int = 0) -> DataFrame:
    """Of each key's rows the one that comes first: in an earlier batch, or in one batch the first by ``order``.

    A key's state is the time at which its row passed; ``keep_ms`` later a
    timer forgets it (0: never). A batch costs its own rows and their keys'
    states; the target is never read. Rows without key go.
    """
    stream = stream.where(F.col(key).isNotNull())
    columns, by = stream.columns, list(order)

    def first(_key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = None
        for part in parts:  # read to the end, also where the key is known
            if not state.exists:
                both = part if best is None else pd.concat([best, part])
                best = both.iloc[[_least(both, by)]]
        if not state.exists and best is not None:
            state.update((int(time.time() * 1000),))
            if keep_ms:
                state.setTimeoutDuration(keep_ms)
            yield best if list(best.columns) == columns else best[columns]

    timeout = GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy(key).applyInPandasWithState(first, stream.schema, "at long", "append", timeout)


def insert_stream(spark: SparkSession, stream: DataFrame, target: VersionedTable, checkpoint: str, key: str, *order: str, keep_ms: int = 0, work: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Drain a stream into a table with versions: each key once, with ``epoch`` and its place ``id`` in it by ``order``, whose first column is a number.

    ``work`` makes the stored rows of a batch's new ones, as fetching does of
    requests. A batch is published as a part named by its number, so one that
    comes again after a failure adds nothing, and is not worked on again once
    it is there.
    """
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def write(batch: DataFrame, epoch: int) -> None:
        rows = materialise(batch, "epoch")  # state is read and written in one pass
        if not rows.isEmpty():
            fresh = numbered(rows, list(order), "id", 1).withColumn("epoch", F.lit(epoch).cast("long"))
            target.append_once(work(fresh) if work else fresh, f"epoch-{epoch}")

    try:
        rows = first_of_key(stream, key, *order, keep_ms=keep_ms)
        query = rows.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def stored_schema(stream: T.StructType) -> T.StructType:
    """Columns of the table that ``insert_stream`` writes."""
    return T.StructType([*stream.fields]).add("id", T.LongType()).add("epoch", T.LongType())
