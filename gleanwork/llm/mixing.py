"""Mixing sources to target weights by systematic sampling.

Each document has an expected number of copies. Inside a source these are
summed along a fixed order, one random offset is added, and a document is
emitted once for each integer boundary that its stretch of the sum crosses.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.llm._shared import materialise, own_columns, seeded_int, word_count

#: Copies are summed in whole numbers of this fraction, so sums do not depend on their order.
UNIT_BITS = 24
UNIT = 1 << UNIT_BITS
#: Rows of a source that one window group holds, roughly.
GROUP_ROWS = 1_000
CYCLE = (5, 2, 1)
SHARE_PERCENT = 150
MOST_COPIES = 2


def size_class(size: Column) -> Column:
    """Quarter powers of two: documents of like size are neighbours in the sum, which keeps the sampled words near the target."""
    return F.when(size > 0, F.floor(F.log2(size.cast("double")) * 4)).otherwise(F.lit(-1)).cast("int")


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, share_percent: int = SHARE_PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, target`` of each source of ``sizes`` (``source, source_size``).

    Weights repeat along the sources by code point, null last. Targets share
    ``share_percent`` of all sizes by weight; one that would pass ``most``
    times its source's size stops there and its excess is shared again by
    weight, until none is above. That fixed point is found in one pass: with
    sources by (most * size / weight), let the level of each be what stopped
    ones before it leave, divided by the weights from it on. Levels rise as
    long as sources stop below them and fall from then on, so the highest is
    the fixed point. The table has a row for each source of the mix, which is
    configuration, not corpus.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    t = sizes.withColumn("weight", F.element_at(weights, ((F.row_number().over(order) - 1) % len(cycle) + 1).cast("int")))
    everything = Window.partitionBy()
    ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    t = t.withColumn("cap", F.col("source_size") * most).withColumn("budget", F.sum("source_size").over(everything) * share_percent / 100)
    t = t.withColumn("below", F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
    t = t.withColumn("above", F.sum("weight").over(ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.col("budget") - F.col("below")) / F.col("above"))
    target = F.least(F.col("cap").cast("double"), F.max("level").over(everything) * F.col("weight"))
    return t.select("source", "source_size", target.alias("target"))


def sample_copies(rows: DataFrame, rate_units: str, source: str, size: str, group: str, key: str, seed: int) -> DataFrame:
    """Add ``copies`` by systematic sampling inside each source.

    ``rate_units`` is a column of expected copies in 1/2**24. The order inside
    a source is (size class, group, size, key). The sum runs inside (source,
    class, group), each about a thousand rows, so a hot source is spread over
    many tasks; the sums before each group come from a table of group totals,
    which is smaller than the rows by that factor.
    """
    keys = [source, "_class", group]
    totals = rows.groupBy(*keys).agg(F.sum(rate_units).alias("_total"))
    before = Window.partitionBy(source).orderBy("_class", group).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    starts = materialise(starts, "mix-starts").select(F.col(source).alias("_s"), F.col("_class").alias("_c"), F.col(group).alias("_g"), "_before")
    on = F.col(source).eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")) & (F.col(group) == F.col("_g"))
    rows = rows.join(starts, on).drop("_s", "_c", "_g")
    inside = Window.partitionBy(*keys).orderBy(size, F.col(key).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offset = seeded_int(F.col(source), seed, UNIT_BITS)
    end = F.col("_before") + F.sum(rate_units).over(inside) + offset
    boundary = lambda x: F.shiftright(x, UNIT_BITS)
    rows = rows.withColumn("_end", end)
    return rows.withColumn("copies", (boundary(F.col("_end")) - boundary(F.col("_end") - F.col(rate_units))).cast("long")).drop("_before", "_end", "_class")


def mix_sources(
    rows: DataFrame, source_col: str = "source", size_col: str = "size", key_col: str = "doc_id",
    cycle: tuple[int, ...] = CYCLE, share_percent: int = SHARE_PERCENT, most: int = MOST_COPIES, seed: int = 20,
) -> DataFrame:
    """Add ``source_size, target, copies`` to each row; ``copies`` is how often the mix takes it.

    All documents of a source share one expected number of copies, target /
    source size, at most ``most``; so no row is taken more often than that,
    and each source's taken sizes differ from its target by about one large
    document at most. Sources without words have target 0. A null source is a
    source of its own and comes last; a null size counts as 0; null keys sort
    first; equal rows are sampled one by one. The result depends only on the
    rows and the seed, not on partitioning. ``rows`` is read twice: pass a
    slim or written table.
    """
    rows = own_columns(rows, ["source_size", "target", "copies"])
    rows = rows.withColumn("_size", F.coalesce(F.col(size_col), F.lit(0)).cast("long"))
    rows = rows.withColumn("_class", size_class(F.col("_size")))
    classes = rows.groupBy(F.col(source_col).alias("_source"), F.col("_class").alias("_of")).agg(F.sum("_size").alias("_sum"), F.count("*").alias("_n"))
    classes = materialise(classes, "mix-classes")
    targets = source_targets(classes.groupBy(F.col("_source").alias("source")).agg(F.sum("_sum").alias("source_size")), cycle, share_percent, most)
    targets = classes.join(targets, F.col("_source").eqNullSafe(F.col("source"))).select("_source", "_of", "_n", "source_size", "target")
    rows = rows.join(materialise(targets, "mix-targets"), F.col(source_col).eqNullSafe(F.col("_source")) & (F.col("_class") == F.col("_of"))).drop("_source", "_of")
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT + 0.5)).otherwise(F.lit(0))
    rows = rows.withColumn("_rate", rate.cast("long"))
    rows = rows.withColumn("_group", (seeded_int(F.col(key_col), seed) % F.greatest(F.lit(1), F.floor(F.col("_n") / GROUP_ROWS))).cast("int"))
    return sample_copies(rows, "_rate", source_col, "_size", "_group", key_col, seed).drop("_rate", "_group", "_size", "_n")


def mix_documents(docs: DataFrame, source_col: str = "source", text_col: str = "text", key_col: str = "doc_id", **options: int) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as it is taken, same columns. Sizes are words.

    Words are counted once, in the pass that writes the rows with their sizes;
    the passes that sum sizes and draw read only slim columns of that table.
    """
    names = docs.columns
    sized = materialise(docs.withColumn("_words", word_count(F.col(text_col))), "mix-sized")
    mixed = mix_sources(sized, source_col, "_words", key_col, **options)
    mixed = mixed.where(F.col("copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    kept = [n for n in mixed.columns if n not in ("_words", "_copy", "source_size", "target", "copies")]
    return mixed.select(*kept).toDF(*names)
