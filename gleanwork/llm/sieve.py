"""A Bloom filter of one hash, to keep rows that cannot join from being moved."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleanwork.llm._shared import materialise

MIN_BITS, MAX_BITS = 1 << 20, 1 << 27
BITS_PER_KEY = 16


def places(keys: list[bytes], bits: int) -> np.ndarray:
    """Bit of each 16-byte key."""
    return (np.frombuffer(b"".join(keys), "<u8")[::2] & np.uint64(bits - 1)).astype(np.int64)


def made(keys: DataFrame, n: int) -> np.ndarray:
    """Bits (one byte each eight) of the 16-byte keys in the first column.

    Sixteen bits a key, 16 MB at most: with more keys it lets more rows pass,
    which costs moves but no result. Tasks send their bits packed; they are
    united in a few tasks before the driver gets them.
    """
    bits = MIN_BITS
    while bits < MAX_BITS and bits < n * BITS_PER_KEY:
        bits *= 2

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            if batch.num_rows:
                own[places(batch.column(0).to_pylist(), bits)] = True
        if own.any():
            yield pa.RecordBatch.from_pydict({"bits": pa.array([zlib.compress(np.packbits(own).tobytes(), 1)], pa.binary())})

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for x in batch.column(0):
                total |= np.frombuffer(zlib.decompress(x.as_py()), np.uint8)
        if total.any():
            yield pa.RecordBatch.from_pydict({"bits": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    total = np.zeros(bits // 8, np.uint8)
    for row in materialise(keys.mapInArrow(mark, "bits binary").repartition(8).mapInArrow(unite, "bits binary"), "sieve").toLocalIterator():
        total |= np.frombuffer(zlib.decompress(bytes(row[0])), np.uint8)
    return total


def passes(sieve: np.ndarray, keys: list[bytes]) -> np.ndarray:
    """Whether each key may be among those the sieve was made of."""
    at = places(keys, len(sieve) * 8)
    return (sieve[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
