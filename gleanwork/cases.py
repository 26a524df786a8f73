"""Known cases carried by the rows of a test table.

Each page takes one of the cases, or all of them, and its own name goes into
the case's texts. So what a case states is checked on as many different rows
as the table has, and the work grows with the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.fixtures import sql_value

#: What a page's own name replaces in texts.
NAME = "orchard"
OWN_SQL = r"'o' || page_id || regexp_extract(url, '([a-z]+)\.example', 1)"
OWNED_SQL = f"SELECT page_id, url AS page_url, {OWN_SQL} AS own FROM pages"


def own_name() -> Column:
    return F.concat(F.lit("o"), F.col("page_id").cast("string"), F.regexp_extract("url", r"([a-z]+)\.example", 1))


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, page_url, own`` of all pages."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("url").alias("page_url"), own_name().alias("own"))


def _named(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.replace(column, F.lit(NAME), F.col("own"))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.transform(column, lambda x: F.replace(x, F.lit(NAME), F.col("own")))
    return column


def _with_names(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.select("page_id", "own", *[_named(F.col(f"_case.{f.name}"), f.dataType).alias(f.name) for f in schema.fields])


def one_case(spark: SparkSession, sf_dir: str, rows: Sequence[tuple], names: str) -> DataFrame:
    """``page_id, own`` and the case that the page takes: the one at its id modulo the number of cases."""
    schema = spark.createDataFrame([], names).schema
    table = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], T.StructType().add("_at", T.LongType()).add("_case", schema))
    return _with_names(owned(spark, sf_dir).withColumn("_at", F.pmod("page_id", F.lit(len(rows)).cast("long"))).join(F.broadcast(table), "_at"), schema)


def all_cases(spark: SparkSession, sf_dir: str, rows: Sequence[tuple], names: str) -> DataFrame:
    """``page_id, own`` with every case."""
    schema = spark.createDataFrame([], names).schema
    table = spark.createDataFrame([(0, list(rows))], T.StructType().add("_at", T.LongType()).add("_cases", T.ArrayType(schema)))
    met = owned(spark, sf_dir).withColumn("_at", F.lit(0).cast("long")).join(F.broadcast(table), "_at")
    return _with_names(met.withColumn("_case", F.explode("_cases")), schema)


def _columns(rows: Sequence[tuple], names: str) -> str:
    listed = [n.strip() for n in names.split(",")]
    return ", ".join(f"replace(t.{n}, '{NAME}', own) AS {n}" if any(isinstance(r[i], str) for r in rows) else f"t.{n} AS {n}" for i, n in enumerate(listed))


def _values(rows: Sequence[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(sql_value, r)) + ")" for r in rows)


def one_case_sql(names: str, rows: Sequence[tuple]) -> str:
    numbered = [(i, *r) for i, r in enumerate(rows)]
    return f"SELECT page_id, {_columns(rows, names)} FROM ({OWNED_SQL}) p JOIN (VALUES {_values(numbered)}) AS t(nth, {names}) ON page_id % {len(rows)} = nth"


def results_sql(names: str, rows: Sequence[tuple], of: int) -> str:
    """Results of numbered cases, of which a page has the one at its id modulo ``of``: rows begin with the case's number."""
    return f"SELECT page_id, {_columns([r[1:] for r in rows], names)} FROM ({OWNED_SQL}) p JOIN (VALUES {_values(rows)}) AS t(nth, {names}) ON page_id % {of} = nth"


def all_cases_sql(names: str, rows: Sequence[tuple]) -> str:
    return f"SELECT page_id, {_columns(rows, names)} FROM ({OWNED_SQL}) p CROSS JOIN (VALUES {_values(rows)}) AS t({names})"
