"""Scans of files into frames with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.functions.text import strip


def read_csv(spark: SparkSession, path: str, schema: T.StructType, na_tokens: Sequence[str] = (), line_breaks: bool = True) -> DataFrame:
    """CSV with a header; fields may hold doubled quotes and, with ``line_breaks``, line breaks. Empty cells (and ``na_tokens``) are null.

    A file whose fields may hold line breaks is read by one task; without them large files are split.
    """
    rows = spark.read.schema(schema).option("header", True).option("multiLine", line_breaks).option("quote", '"').option("escape", '"').csv(path)
    if na_tokens:
        rows = rows.select(*[F.when(~F.col(c).isin(*na_tokens), F.col(c)).alias(c) for c in rows.columns])
    return rows


def read_boards(spark: SparkSession, path: str) -> DataFrame:
    """Boards without comment rows, whose company starts with #."""
    from gleanwork.schemas import BOARDS

    return without_comments(read_csv(spark, path, BOARDS))


def without_comments(rows: DataFrame, column: str = "company") -> DataFrame:
    return rows.where(~F.coalesce(F.ltrim(column).startswith("#"), F.lit(False)))


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The CSV file, or no rows with its columns if there is none."""
    try:
        return read_csv(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """``word``: lines stripped and in lower case, blank ones left out."""
    return spark.read.text(path).select(F.lower(strip("value")).alias("word")).where("word <> ''")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """``path, value`` of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def file_stamps(spark: SparkSession, path: str) -> DataFrame:
    """``path, stamp`` of files, to the minute."""
    files = spark.read.format("binaryFile").load(path).select("path", F.date_format("modificationTime", "yyyy-MM-dd HH:mm").alias("stamp"))
    return files


def file_stamp(spark: SparkSession, path: str) -> str:
    """Time of the newest file at ``path``, or "never"."""
    try:
        found = file_stamps(spark, path).agg(F.max("stamp")).first()[0]
    except AnalysisException:
        found = None
    return found or "never"


def locale_table(spark: SparkSession, folder: str) -> DataFrame:
    """``locale, key, value`` of the files ``values_<locale>.json`` in a folder."""
    files = read_whole(spark, f"{folder}/values_*.json")
    pairs = F.explode(F.from_json("value", "map<string,string>")).alias("key", "value")
    return files.select(F.regexp_extract("path", r"values_([^./]+)\.json$", 1).alias("locale"), pairs)
