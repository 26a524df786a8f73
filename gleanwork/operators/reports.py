"""Frames behind the dashboard: counts, histograms, top lists, accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = "(blank)"
# --- fixed values: the grammar of a reason line ---
REASON = r"^(.*?)(?:\s*\((\d+) anchors, (\d+) scripts(?:, ([^)]*))?\))?(?:\s*\(redirected to ([^)]*)\))?$"
# --- end of fixed values ---


def value_counts(rows: DataFrame, column: str, top: int = 0) -> DataFrame:
    """``label, n``: rows of each value, blanks in one bucket, most frequent first, ties by label."""
    label = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(BLANK))
    counts = rows.groupBy(label.alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")
    return counts.limit(top) if top else counts


def distinct_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: distinct non-blank values of each column as ``n_<column>``."""
    return rows.agg(*[F.countDistinct(F.nullif(F.col(c).cast("string"), F.lit(""))).alias(f"n_{c}") for c in columns])


#: Distinct values that may come to the driver in the last step of a selection.
LAST_VALUES = 20_000


def values_at(rows: DataFrame, column: str, ranks: list[int]) -> list[float]:
    """Values at some ranks (from 0) of a column's numbers in order; nulls do not count.

    Each round asks a mergeable sketch for two values around the ranks, counts
    what lies below and between them exactly, and goes on between them. Ranks
    outside widen the stretch again. So no task holds the column, and the driver
    gets a bounded number of distinct values with their counts.
    """
    numbers = rows.select(F.col(column).cast("double").alias("v")).where("v is not null")
    low, high, below = None, None, 0

    def inside(a: float | None, b: float | None) -> DataFrame:
        found = numbers
        if a is not None:
            found = found.where(F.col("v") >= F.lit(a))
        return found if b is None else found.where(F.col("v") <= F.lit(b))

    while True:
        part = inside(low, high)
        n, distinct = part.agg(F.count("*"), F.approx_count_distinct("v")).first()
        if distinct <= LAST_VALUES // 2:
            counts = part.groupBy("v").count().orderBy("v").limit(LAST_VALUES + 1).collect()
            if len(counts) <= LAST_VALUES:
                break
        first, last = (min(ranks) - below) / n, (max(ranks) - below) / n
        a, b = part.agg(F.percentile_approx("v", [max(0.0, first - 0.01), min(1.0, last + 0.01)], 1000)).first()[0]
        under, upto = part.agg(F.count_if(F.col("v") < F.lit(a)), F.count_if(F.col("v") <= F.lit(b))).first()
        if not under <= min(ranks) - below <= max(ranks) - below < upto or upto - under == n:
            a, b = part.agg(F.percentile_approx("v", [max(0.0, first - 0.1), min(1.0, last + 0.1)], 100_000)).first()[0]
            under = part.where(F.col("v") < F.lit(a)).count()
        low, high, below = a, b, below + under
    out, at = {}, below
    for value, k in counts:
        out |= {r: value for r in ranks if at <= r < at + k}
        at += k
    return [out[r] for r in ranks]


def mean_median(rows: DataFrame, column: str) -> DataFrame:
    """One row: ``mean`` and the exact ``median``, both null without values."""
    n = rows.where(F.col(column).isNotNull()).count()
    middle = values_at(rows, column, [(n - 1) // 2, n // 2]) if n else [None, None]
    median = None if middle[0] is None else (middle[0] + middle[1]) / 2
    return rows.agg(F.avg(column).alias("mean"), F.lit(median).cast("double").alias("median"))


def group_means(rows: DataFrame, group: str, value: str, top: int = 15) -> DataFrame:
    """``group, mean`` of the groups with the highest means, ties by group."""
    return rows.groupBy(F.col(group).alias("label")).agg(F.avg(value).alias("mean")).orderBy(F.desc("mean"), "label").limit(top)


def histogram(rows: DataFrame, value: str, width: int = 5, upto: int = 100) -> DataFrame:
    """``low, n`` of each bin from 0; the last bin includes its upper edge, values outside are left out, empty bins have 0."""
    last = upto // width - 1
    inside = rows.where(F.col(value).between(0, upto))
    counts = inside.groupBy(F.least(F.floor(F.col(value) / width), F.lit(last)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    bins = rows.sparkSession.range(last + 1).withColumnRenamed("id", "bin")
    return bins.join(counts, "bin", "left").select((F.col("bin") * width).alias("low"), F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy("low")


def largest(rows: DataFrame, value: str, n: int, *ties: str) -> DataFrame:
    """The rows with the largest values; of equal ones those first by ``ties``."""
    return rows.where(F.col(value).isNotNull()).orderBy(F.desc(value), *ties).limit(n)


def parse_reasons(rows: DataFrame, column: str = "reason") -> DataFrame:
    """Add ``cause, anchors, scripts, marker, redirect`` read from a reason line; parts that it lacks are null."""

    def part(i: int) -> Column:
        return F.regexp_extract(column, REASON, i)

    some = F.rlike(F.col(column), F.lit(REASON))
    return rows.withColumns({
        "cause": F.when(some, part(1)), "anchors": F.nullif(part(2), F.lit("")).cast("double"), "scripts": F.nullif(part(3), F.lit("")).cast("double"),
        "marker": F.nullif(part(4), F.lit("")), "redirect": F.nullif(part(5), F.lit("")),
    })


def non_null_counts(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.agg(*[F.count(c).alias(f"n_{c}") for c in columns])


def per_board(boards: DataFrame, jobs: DataFrame, failures: DataFrame) -> DataFrame:
    """``url, n`` of each board: jobs found, null where it failed."""
    counts = jobs.groupBy("board_url").agg(F.count("url").alias("_n"))
    failed = failures.select(F.col("board_url").alias("_f")).distinct().withColumn("_failed", F.lit(True))
    rows = boards.select("url").distinct().join(counts, F.col("url") == F.col("board_url"), "left").join(failed, F.col("url") == F.col("_f"), "left")
    return rows.select("url", F.when(F.col("_failed").isNull(), F.coalesce("_n", F.lit(0))).alias("n"))


def accuracy(rows: DataFrame, expected: str, predicted: str, negative: str = "unknown") -> DataFrame:
    """``label, tp, fp, fn, precision, recall`` of each class but ``negative``; ratios without cases are 0."""
    right = F.col(expected) == F.col(predicted)
    sides = F.array(
        F.struct(F.col(expected).alias("label"), F.when(right, 1).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(right, 0).otherwise(1).alias("fn")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).alias("tp"), F.when(right, 0).otherwise(1).alias("fp"), F.lit(0).alias("fn")),
    )
    counts = rows.select(F.inline(sides)).where(F.col("label") != negative).groupBy("label").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])

    def ratio(other: str) -> Column:
        total = F.col("tp") + F.col(other)
        return F.when(total > 0, F.col("tp") / total).otherwise(F.lit(0.0))

    return counts.select("*", ratio("fp").alias("precision"), ratio("fn").alias("recall")).where("tp + fp + fn > 0").orderBy("label")


def rejected_negatives(rows: DataFrame, expected: str, predicted: str, negative: str = "unknown") -> DataFrame:
    """One row: negative cases and how many were told as such."""
    mine = rows.where(F.col(expected) == negative)
    return mine.agg(F.count("*").alias("negatives"), F.count_if(F.col(predicted) == negative).alias("rejected"))


def host_sample(rows: DataFrame, host: str, key: str, labelled: str, most: int, limit: int = 0) -> DataFrame:
    """At most ``most`` rows of each host, labelled ones first, the rest by md5 of the key."""
    from pyspark.sql import Window

    order = Window.partitionBy(host).orderBy(F.desc(labelled), F.md5(key), key)
    found = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
    return found.orderBy(F.desc(labelled), F.md5(key), key).limit(limit) if limit else found


def row_at(rows: DataFrame, place: int, *order: Column | str) -> DataFrame:
    """The row at a place (from 0) of the ordered rows; none beyond the last. Only the rows up to it leave a task."""
    return rows.orderBy(*order).offset(place).limit(1)


def complete(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with a value in all of these columns."""
    return rows.na.drop(subset=list(columns))


def chart_spec(report: DataFrame, mark: str, x: str, y: str) -> DataFrame:
    """One row: ``spec``, a Vega-Lite chart of a report with its rows inside. Reports are counts, bins or top rows, so the text stays small."""
    kind = lambda name: "quantitative" if report.schema[name].dataType.typeName() in ("integer", "long", "double", "float", "short") else "nominal"
    side = lambda name: F.struct(F.lit(name).alias("field"), F.lit(kind(name)).alias("type"))
    values = F.array_sort(F.collect_list(F.struct(*report.columns)))
    spec = F.struct(F.lit(mark).alias("mark"), F.struct(side(x).alias("x"), side(y).alias("y")).alias("encoding"), F.struct(values.alias("values")).alias("data"))
    return report.agg(F.to_json(spec).alias("spec"))
