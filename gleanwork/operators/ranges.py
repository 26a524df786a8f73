"""Numbers along a total order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order is first cut at this many measured quantiles.
QUANTILES = 64


def stretch_of(rows: DataFrame, name: str, width: int) -> Column:
    """Number, along the order of a numeric column, of a stretch that holds about ``width`` rows; nulls are before the first.

    The column is cut at measured quantiles, so that clusters and outliers
    have stretches of their own, and evenly between two of them. One pass over
    the column; the driver gets the quantiles.
    """
    shares = [i / QUANTILES for i in range(QUANTILES + 1)]
    n, cuts = rows.agg(F.count(name), F.percentile_approx(F.col(name), shares, 4096)).first()
    cuts = sorted({float(x) for x in cuts or []})
    if len(cuts) < 2:
        return F.when(F.col(name).isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long")
    parts = max(1, -(-n // (width * (len(cuts) - 1))))
    value = F.col(name).cast("double")
    at = sum(((value >= F.lit(x)).cast("int") for x in cuts[1:-1]), F.lit(0))
    low, high = (F.element_at(F.array(*map(F.lit, x)), at + 1) for x in (cuts[:-1], cuts[1:]))
    inside = F.floor((value - low) / (high - low) * parts)
    place = at * parts + F.greatest(F.lit(0), F.least(inside, F.lit(parts - 1)))
    return F.coalesce(place, F.lit(-1)).cast("long")


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 1, width: int = 4096) -> DataFrame:
    """Add ``name``: consecutive numbers by ``order``, from ``start``.

    The first order column is a number; stretches of about ``width`` rows of it
    are numbered apart, each after the sizes of the stretches before it, so
    only one row for each stretch meets in a task. Rows of one value of that
    column share a stretch. The result does not depend on partitioning.
    """
    dealt = rows.withColumn("_part", stretch_of(rows, order[0], width))
    inside = Window.partitionBy("_part").orderBy(*order)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    dealt = dealt.withColumn("_n", F.row_number().over(inside)).join(starts, F.col("_part") == F.col("_p"))
    return dealt.withColumn(name, (F.col("_n") + F.col("_before") + (start - 1)).cast("long")).drop("_part", "_p", "_n", "_before")
