"""Short forms of types for UDFs: their modules are imported on executors, where no DDL can be parsed."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, BOOLEAN, BINARY = T.StringType(), T.LongType(), T.BooleanType(), T.BinaryType()
STRINGS = T.ArrayType(STRING)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def structs(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(struct(**fields))
