"""Document fingerprints by consistent weighted sampling.

Each sample draws, for every weighted term, two gamma variables and a uniform
shift from the term's hash, quantises the logarithm of the weight with them,
and keeps the term and level of least cost. The share of equal samples of two
fingerprints estimates the generalised Jaccard similarity of their weights.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.llm._shared import ASCII_SPACES, materialise

SAMPLES = 64
SEED = 11
#: Documents of one bucket of the id order.
BUCKET_ROWS = 400
SPLIT = f"[{ASCII_SPACES}]+"


def sample_cost(term: Column, log_weight: Column, sample: int, seed: int = SEED) -> Column:
    """Cost (high bits, ascending) and identity (low 32 bits) of a term in one sample, as a long.

    With r, c from Gamma(2, 1) and b uniform: t = floor(ln w / r + b), cost
    ln c - r (t - b + 1). Gamma(2, 1) is minus the logarithm of a product of
    two uniforms; all of them are bits of two hashes of the term.
    """
    one = F.xxhash64(term, F.lit(2 * sample + 1000 * seed))
    two = F.xxhash64(term, F.lit(2 * sample + 1 + 1000 * seed))

    def uniform(bits: Column, width: int) -> Column:
        return (bits.cast("double") + 0.5) * (1.0 / (1 << width))

    u1 = uniform(F.shiftrightunsigned(one, 42), 22)
    u2 = uniform(F.shiftrightunsigned(one, 20).bitwiseAND(F.lit((1 << 22) - 1)), 22)
    shift = uniform(one.bitwiseAND(F.lit((1 << 20) - 1)), 20)
    u3 = uniform(F.shiftrightunsigned(two, 32), 32)
    u4 = uniform(two.bitwiseAND(F.lit((1 << 32) - 1)), 32)
    r = -F.ln(u1 * u2)
    t = F.floor(log_weight / r + shift)
    cost = F.ln(-F.ln(u3 * u4)) - r * (t.cast("double") - shift + 1.0)
    high = ((cost + 256.0) * float(1 << 21)).cast("long")
    identity = two.bitwiseXOR(t * F.lit(0x9E3779B1)).bitwiseAND(F.lit((1 << 32) - 1))
    return F.shiftleft(high, 32).bitwiseOR(identity)


def signatures(terms: DataFrame, by: list[str], term: str = "term", weight: str = "weight", samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """``s0 .. s<n>`` of each group: the least cost-and-identity of each sample.

    ``terms`` has distinct (group, term) rows with positive weights; others are
    dropped as terms of no weight. Minima are combined before any shuffle.
    """
    rows = terms.where(F.col(weight) > 0).withColumn("_lw", F.ln(F.col(weight).cast("double")))
    return rows.groupBy(*by).agg(*[F.min(sample_cost(F.col(term), F.col("_lw"), i, seed)).alias(f"s{i}") for i in range(samples)])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; two fingerprints without terms are alike, one without is unlike any other."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(same.cast("double") / F.size(a))


def fingerprint_text(signature: Column) -> Column:
    """Eight hex digits of each sample's identity; empty for texts without terms."""
    digits = F.transform(signature, lambda v: F.lpad(F.lower(F.hex(v.bitwiseAND(F.lit((1 << 32) - 1)))), 8, "0"))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def with_neighbours(docs: DataFrame) -> DataFrame:
    """``bucket, row, extra, doc_id, text, next_text`` in ascending ``doc_id`` order, each bucket in one partition.

    The order is cut into buckets by arithmetic on the ids. Each bucket also
    gets a copy of the first document of the next one (the last bucket: of the
    first), marked ``extra``, so every document finds its follower beside it.
    Null ids come first; equal ids are ordered by their texts' hashes.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    low, high, n = base.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    width = max(1, (int(high or 0) - int(low or 0) + 1) // max(1, int(n) // BUCKET_ROWS))
    bucket = F.coalesce(F.floor((F.col("doc_id") - F.lit(low or 0)) / F.lit(width)), F.lit(-1)).cast("long")
    base = base.withColumn("bucket", bucket)
    heads = base.groupBy("bucket").agg(F.min("doc_id").alias("head"))
    order = Window.orderBy("bucket")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("bucket").over(order), F.last("bucket").over(everything))
    heads = materialise(heads.select(F.col("bucket").alias("_of"), F.col("head").alias("_head"), before.alias("_to")), "fingerprint-heads")
    extra = base.join(heads, (F.col("bucket") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_head"))).select("doc_id", "text", F.coalesce("_to", F.lit(-1)).cast("long").alias("bucket"), F.lit(1).alias("extra"))
    rows = base.withColumn("extra", F.lit(0)).unionByName(extra).repartition("bucket")
    inside = Window.partitionBy("bucket").orderBy("extra", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.select("*", F.row_number().over(inside).alias("row"), F.lead("text").over(inside).alias("next_text"))
    # of several first rows with equal ids only the one of least hash follows
    firsts = Window.partitionBy("bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_extras", F.coalesce(F.sum("extra").over(firsts), F.lit(0))).where("extra = 0 or _extras = 0").drop("_extras")


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness.

    ``docs`` has ``doc_id, text``. The edited text is the text with its last
    floor(n/4) code points replaced by the first as many (or all) of the next
    document. Terms are lower-case words, weights their counts. Returns
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. Null texts are empty; texts without words have
    an empty fingerprint; repeated rows are documents of their own; a single
    document is its own follower. The texts are dealt once, by stretches of
    the id order; all else happens inside those partitions.
    """
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = with_neighbours(docs)
    cut = F.substring(F.col("text"), F.lit(1), n - quarter)
    put = F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter)
    info = rows.select("bucket", "row", "extra", "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.concat(cut, put), 256).alias("edited_sha256"))
    parts = rows.select("bucket", "row", "extra", F.lower(cut).alias("cut"), F.lower(F.substring(F.col("text"), n - quarter + 1, quarter)).alias("rest"), F.lower(put).alias("put"))
    parts = parts.withColumn("whole", F.regexp_replace("cut", f"[^{ASCII_SPACES}]+$", ""))
    parts = parts.withColumn("broken", F.substring(F.col("cut"), F.length("whole") + 1, F.length("cut")))
    # 0: in both texts, 1: in the text, 2: in the edited text
    segments = F.array(
        F.struct(F.lit(0).alias("side"), F.col("whole").alias("words")),
        F.struct(F.lit(1).alias("side"), F.concat("broken", "rest").alias("words")),
        F.struct(F.lit(2).alias("side"), F.concat("broken", "put").alias("words")),
    )
    tokens = parts.select("bucket", "row", F.explode(segments).alias("s")).select("bucket", "row", F.col("s.side").alias("side"), F.explode(F.split("s.words", SPLIT)).alias("word"))
    tokens = tokens.where("word <> ''").select("bucket", "row", "side", F.xxhash64("word").alias("term"))
    counts = tokens.groupBy("bucket", "row", "term").agg(F.count(F.when(F.col("side") != 2, 1)).alias("own"), F.count(F.when(F.col("side") != 1, 1)).alias("edited"))
    # terms of equal weight in both texts are sampled once
    weights = F.when(F.col("own") == F.col("edited"), F.array(F.struct(F.lit(0).alias("side"), F.col("own").alias("weight")))).otherwise(
        F.array(F.struct(F.lit(1).alias("side"), F.col("own").alias("weight")), F.struct(F.lit(2).alias("side"), F.col("edited").alias("weight")))
    )
    terms = counts.select("bucket", "row", "term", F.explode(weights).alias("w")).select("bucket", "row", "term", F.col("w.side").alias("side"), F.col("w.weight").alias("weight"))
    made = signatures(terms, ["bucket", "row", "side"], samples=samples, seed=seed)
    arrays = made.select("bucket", "row", "side", F.array(*[f"s{i}" for i in range(samples)]).alias("s"))
    both = arrays.groupBy("bucket", "row").agg(*[
        F.min(F.when(F.col("side") != other, F.col("s")[i])).alias(f"{name}{i}") for name, other in (("t", 2), ("e", 1)) for i in range(samples)
    ])
    whole = [F.when(F.col(f"{x}0").isNotNull(), F.array(*[f"{x}{i}" for i in range(samples)])).alias(y) for x, y in (("t", "own"), ("e", "edited"))]
    met = info.join(both.select("bucket", "row", *whole), ["bucket", "row"], "left")
    inside = Window.partitionBy("bucket").orderBy("row")
    met = met.withColumn("next", F.lead("own").over(inside))
    return met.where("extra = 0").select(
        "doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("own")).alias("fingerprint"), fingerprint_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
