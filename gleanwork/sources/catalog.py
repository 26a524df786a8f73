"""Tables by name: created where absent, given further columns, filled by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _quoted(name: str) -> str:
    return ".".join(f"`{p}`" for p in name.split("."))


def ensure_table(spark: SparkSession, name: str, columns: str, location: str | None = None) -> bool:
    """Create the table if there is none of this name; whether it was created."""
    if spark.catalog.tableExists(name):
        return False
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_quoted(name)} ({columns}) USING parquet{at}")
    return True


def add_columns(spark: SparkSession, name: str, columns: dict[str, tuple[str, str]]) -> list[str]:
    """Add the columns that the table lacks, each ``(type, default)``; returns their names.

    The default is kept with the column, so stored rows have it at once and no
    file is written again. Running it a second time adds nothing.
    """
    have = {c.lower() for c in spark.table(name).columns}
    fresh = {c: t for c, t in columns.items() if c.lower() not in have}
    if fresh:
        spark.sql(f"ALTER TABLE {_quoted(name)} ADD COLUMNS (" + ", ".join(f"`{c}` {kind} DEFAULT {value}" for c, (kind, value) in fresh.items()) + ")")
        spark.catalog.refreshTable(name)
    return list(fresh)


def insert_by_name(rows: DataFrame, name: str) -> None:
    """Append rows; columns are matched by name, and those that the rows lack take their defaults."""
    rows.sparkSession.sql(f"INSERT INTO {_quoted(name)} BY NAME SELECT * FROM {{rows}}", rows=rows)
