"""Sums of large arrays of counters that tasks make, in blocks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleanwork.llm._shared import materialise

BLOCKS = 64
SCHEMA = "block int, rows long, counts binary"


def packed(sums: dict[int, np.ndarray], rows: dict[int, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "block": pa.array(list(sums), pa.int32()), "rows": pa.array([rows.get(b, 0) for b in sums], pa.int64()),
        "counts": pa.array([zlib.compress(x.astype("<i8").tobytes(), 1) for x in sums.values()], pa.binary()),
    })


def summed_counters(data: DataFrame, size: int, count: Callable[[np.ndarray, pa.RecordBatch], None], label: str) -> tuple[np.ndarray, int]:
    """Counters of all rows of ``data``, and the number of rows.

    ``count`` adds a batch to its task's ``size`` counters (a multiple of 64).
    A task sends its array once, packed, as 64 blocks; blocks are summed in
    two rounds, a task's share of each block at a time. The driver gets 8
    bytes for each counter, whatever the number of rows.
    """
    each = size // BLOCKS

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.int64)
        n = 0
        for batch in batches:
            n += batch.num_rows
            count(table, batch)
        if n:
            for i in range(BLOCKS):
                yield packed({i: table[i * each : (i + 1) * each]}, {0: n})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        rows: dict[int, int] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column(0)[i].as_py()
                values = np.frombuffer(zlib.decompress(batch.column(2)[i].as_py()), "<i8")
                sums[block] = sums[block] + values if block in sums else values
                rows[block] = rows.get(block, 0) + batch.column(1)[i].as_py()
        for block, values in sums.items():
            yield packed({block: values}, rows)

    shared = data.mapInArrow(local, SCHEMA).repartition(32).mapInArrow(add, SCHEMA).repartition(16, "block").mapInArrow(add, SCHEMA)
    table, n = np.zeros(size, np.int64), 0
    for block, rows, counts in materialise(shared, label).toLocalIterator():
        table[block * each : (block + 1) * each] += np.frombuffer(zlib.decompress(bytes(counts)), "<i8")
        n += rows
    return table, n
