"""Helpers that the operators of this subpackage have in common.

Nothing here knows a table layout: callers name their columns.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and TAB..CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
ASCII_SPACES = " \t\n\r\x0b\x0c"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (single-machine tests) a temporary folder is made and recorded there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_dir.get() if set_dir.isDefined() else None
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="gleanwork-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Cuts lineage, survives lost executors, and gives the planner true sizes.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at 8 MB: rows are whole texts, and a batch has several copies on its way through a worker."""
    name, most = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
    size = spark.conf.get(name, None)
    digits = "".join(c for c in size or "" if c.isdigit() or c == "-")
    if size is None or not size.endswith("b") or int(digits or 0) > most or int(digits or 0) <= 0:
        spark.conf.set(name, f"{most}b")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def own_columns(df: DataFrame, reserved: Iterable[str]) -> DataFrame:
    """Rename columns of the input that clash with the operator's outputs to ``<name>_in``."""
    reserved = {x.lower() for x in reserved}
    taken = {x.lower() for x in df.columns}
    names = []
    for name in df.columns:
        new = name
        if name.lower() in reserved:
            new = f"{name}_in"
            while new.lower() in taken or new.lower() in reserved:
                new += "_"
            taken.add(new.lower())
        names.append(new)
    return df.toDF(*names)


def word_count(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def seeded_int(key: Column, seed: int, bits: int = 32) -> Column:
    """Integer below 2**bits (a multiple of 4, up to 60) from md5, alike in any SQL engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, bits // 4), 16, 10).cast("long")


def byte_values(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Rows as bytes, null as empty, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def text_values(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterable[pa.RecordBatch]:
    """Slices of a batch with about ``most_bytes`` of text each, one row at least."""
    array = batch.column(batch.schema.get_field_index(column))
    size = 0
    start = 0
    lengths = pc.binary_length(array).fill_null(0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(lengths):
        if i > start and size + n > most_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def is_local(uri: str) -> bool:
    return uri.startswith("file:") or "://" not in uri


def local_path(uri: str) -> str:
    return uri[len("file:"):].replace("//", "/", 1) if uri.startswith("file:") else uri


def write_bytes(uri: str, data: bytes) -> None:
    """Write a whole file so that it appears at once; any store that pyarrow knows."""
    if is_local(uri):
        path = local_path(uri)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as out:
            out.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as out:
        out.write(data)


def read_bytes(uri: str) -> bytes:
    if is_local(uri):
        with open(local_path(uri), "rb") as f:
            return f.read()
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        return f.read()
