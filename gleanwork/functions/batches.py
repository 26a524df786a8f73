"""UDFs over rows whose memory does not grow with Spark's batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Tuple  # noqa: UP035  (Spark tells the kind of a UDF from this form)

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# --- fixed values: what is held as Python objects at a time ---
SLICE_ROWS, SLICE_BYTES = 64, 1 << 20
# --- end of fixed values ---


def _sizes(column: pa.Array) -> list[int]:
    """Bytes of each value of a column of texts or bytes, 0 for others."""
    kind = column.type
    if not (pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)):
        return [0] * len(column)
    return [n or 0 for n in pc.binary_length(column).to_pylist()]


def slices(columns: tuple[pa.Array, ...]) -> Iterator[tuple[int, int]]:
    """Start and length of stretches of rows: 64 at most, and no more than fit 1 MiB of texts, but one row at least."""
    start = held = 0
    for i, size in enumerate(map(sum, zip(*map(_sizes, columns), strict=True))):
        if i > start and (i - start >= SLICE_ROWS or held + size > SLICE_BYTES):
            yield start, i - start
            start, held = i, 0
        held += size
    if len(columns[0]) > start:
        yield start, len(columns[0]) - start


def _plain(kind: T.DataType) -> Callable[[object], object] | None:
    """What makes a value of this type one that Arrow takes, null for values that it takes as they are."""
    if isinstance(kind, T.MapType):
        return lambda value: None if value is None else list(value.items())
    if isinstance(kind, T.StructType) and (inner := {f.name: g for f in kind.fields if (g := _plain(f.dataType))}):
        return lambda value: None if value is None else value | {name: g(value[name]) for name, g in inner.items()}
    return None


def row_udf(kind: T.DataType) -> Callable[[Callable], Callable]:
    """A UDF from a function of one row's values (``None`` for nulls).

    Spark hands over batches of 10,000 rows or 64 MB. Only a slice of one is
    held as Python objects, with its results, which go back slice by slice: so
    a row that gives thousands of values costs its own slice's memory.
    """

    def wrap(one: Callable) -> Callable:
        arrow, plain = to_arrow_type(kind), _plain(kind)

        def results(columns: tuple[pa.Array, ...]) -> Iterator[pa.Array]:
            for start, length in slices(columns):
                found = (one(*row) for row in zip(*(c.slice(start, length).to_pylist() for c in columns), strict=True))
                yield pa.array([plain(x) for x in found] if plain else list(found), type=arrow)

        def run(parts: Iterator[Tuple[pa.Array, ...]]) -> Iterator[pa.Array]:  # noqa: UP006
            for part in parts:
                columns = part if isinstance(part, tuple) else (part,)
                if len(columns[0]):
                    yield from results(columns)
                else:
                    yield pa.array([], type=arrow)

        run.__name__, run.__doc__ = one.__name__, one.__doc__
        return F.arrow_udf(run, kind)

    return wrap
