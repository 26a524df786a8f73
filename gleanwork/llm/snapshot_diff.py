"""Difference of two snapshots of a table, with rows found again under another key.

Texts never move. Each row is cut down to its key and a digest of each
compared column; those slim rows are range-partitioned and sorted twice by
``repartitionAndSortWithinPartitions``: by key, where a generator merges the
two snapshots' rows of a key, and what stays alone once more by content, side
and directed key (ascending in the earlier, descending in the later snapshot),
where two pointers walk through both sides of a content.

A group (key or content) that fills whole stretches of the measured order is
cut inside. Its rows are numbered along the order, with a count from each
stretch as the carry, and meet by number in blocks. So no task sees a hot group
as a whole, and the driver gets a sample and a few counts for each partition.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.llm._shared import materialise, own_columns

OLD, NEW = 0, 1
#: Stands for the null key in sorted keys: it is below all longs.
NO_KEY = -(1 << 63) - 1
DIGEST = 16
ROWS_PER_PARTITION = 1_000_000
#: Sampled keys for each partition.
SAMPLES = 60
#: Numbers of a cut group that meet in one place.
BLOCK = 256

#: Group, side and order, as a sort key.
Key = tuple


def digest(column: Column) -> Column:
    """16 bytes that tell values apart; zeros for null."""
    own = F.substring(F.unhex(F.sha2(column.cast("string"), 256)), 1, DIGEST)
    return F.coalesce(own, F.lit(bytearray(DIGEST)))


def slim_rows(df: DataFrame, side: int, key: str, columns: list[str]) -> DataFrame:
    """Side, key, joined digests, and (later rows) the digest of the row as text."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]
    whole = F.sha2(F.concat_ws("\n", *texts), 256) if side == NEW else F.lit(None).cast("string")
    return df.select(
        F.lit(side).alias("side"), F.col(key).cast("long").alias("key"),
        F.concat(*[digest(F.col(c)) for c in columns]).alias("content"), whole.alias("row_sha256"),
    )


def cuts_of(sample: list[Key], n: int) -> tuple[list[Key], set]:
    """Borders of ``n`` stretches, and the groups that are cut inside.

    A group that holds one border at most stays whole: its border moves to its begin.
    """
    sample = sorted(sample)
    borders = [sample[len(sample) * i // n] for i in range(1, n)] if sample else []
    groups = [b[0] for b in borders]
    hot = {a for a, b in zip(groups, groups[1:], strict=False) if a == b}
    cuts = sorted({b if b[0] in hot else (b[0],) for b in borders} | {(g,) for g in hot})
    return cuts, hot


def two_pointers(rows: Iterable[tuple[Key, tuple]]) -> Iterator[tuple[tuple | None, tuple | None]]:
    """Pairs of the i-th earlier and i-th later row of each group; rows without partner stand alone.

    Rows come by group and side; of a group, the earlier ones are held until the later ones have passed.
    """
    group, held, at = None, [], 0
    for (own, side, *_), row in rows:
        if own != group:
            yield from ((x, None) for x in held[at:])
            group, held, at = own, [], 0
        if side == OLD:
            held.append(row)
        elif at < len(held):
            yield held[at], row
            held[at] = None
            at += 1
        else:
            yield None, row
    yield from ((x, None) for x in held[at:])


def numbered(rows: Iterator[tuple[Key, tuple]], hot: set, carry: dict) -> Iterator[tuple[Key, tuple]]:
    """Rows of the cut groups, keyed by group and number among the rows of their side."""
    at: dict[tuple, int] = dict(carry)
    for (group, side, *_), row in rows:
        if group in hot:
            i = at.get((group, side), 0)
            at[group, side] = i + 1
            yield ((group, i), side), row


def pair_sorted(rows: RDD, sample: list[Key], n: int) -> RDD:
    """``(earlier row or None, later row or None)`` for all rows, keyed ``((group, side, order), row)``."""
    cuts, hot = cuts_of(sample, n)
    dealt = rows.repartitionAndSortWithinPartitions(len(cuts) + 1, lambda k: bisect_right(cuts, k))
    pairs = dealt.mapPartitions(lambda part: two_pointers(x for x in part if x[0][0] not in hot))
    if not hot:
        return pairs

    def counts(i: int, part: Iterator) -> Iterator[tuple]:
        found: dict[tuple, int] = {}
        for (group, side, *_), _row in part:
            if group in hot:
                found[group, side] = found.get((group, side), 0) + 1
        return iter([(i, found)] if found else [])

    carries: dict[int, dict] = {}
    upto: dict[tuple, int] = {}
    for i, found in sorted(dealt.mapPartitionsWithIndex(counts).collect(), key=lambda x: x[0]):
        carries[i] = {k: upto.get(k, 0) for k in found}
        for k, m in found.items():
            upto[k] = upto.get(k, 0) + m
    ranked = dealt.mapPartitionsWithIndex(lambda i, part: numbered(part, hot, carries.get(i, {})))
    met = ranked.repartitionAndSortWithinPartitions(n, lambda k: zlib.crc32(repr((k[0][0], k[0][1] // BLOCK)).encode()) % n)
    return pairs.union(met.mapPartitions(two_pointers))


def partitions(df: DataFrame) -> tuple[int, int]:
    rows = df.count()
    return rows, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_PARTITION))


def sampled(df: DataFrame, rows: int, n: int, key: list[str]) -> list[tuple]:
    """Sort keys of some rows, ``SAMPLES`` for each partition on average (all of a small table)."""
    share = min(1.0, SAMPLES * n / max(rows, 1))
    return [tuple(r) for r in (df if share >= 1 else df.sample(share, seed=5)).select(*key).collect()]


def of_key(key: int | None) -> int:
    return NO_KEY if key is None else key


def key_order(side: int, key: int | None, content: bytes) -> Key:
    return of_key(key), side, bytes(content)


def content_order(side: int, key: int | None, content: bytes) -> Key:
    return bytes(content), side, of_key(key) if side == OLD else -of_key(key)


PAIRED = "old_key long, key long, old_content binary, content binary, row_sha256 string, is_old boolean, is_new boolean"


def paired_rows(rows: DataFrame, order, label: str) -> DataFrame:  # noqa: ANN001
    """Slim rows paired by one of the orders, written once."""
    spark = rows.sparkSession
    total, n = partitions(rows)
    if not total:
        return spark.createDataFrame([], PAIRED)
    sample = [order(*x) for x in sampled(rows, total, n, ["side", "key", "content"])]
    keyed = rows.select("side", "key", "content", "row_sha256").rdd.map(lambda r: (order(r[0], r[1], r[2]), (r[1], bytes(r[2]), r[3])))

    def out(pair: tuple) -> tuple:
        old, new = pair
        return (
            old[0] if old else None, new[0] if new else None, old[1] if old else None, new[1] if new else None,
            new[2] if new else None, old is not None, new is not None,
        )

    return materialise(spark.createDataFrame(pair_sorted(keyed, sample, n).map(out), PAIRED, verifySchema=False), label)


def diff_snapshots(earlier: DataFrame, later: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each pair or unpaired row: ``key, old_key, op, changed, row_sha256``.

    Rows of equal keys pair (``same`` or ``update``); of the rest, rows whose
    ``columns`` are all equal pair, the i-th smallest earlier with the i-th
    largest later key (``rekey``); what is left is ``insert`` or ``delete``.
    ``changed`` names a pair's differing columns. ``row_sha256`` is of the later
    row's values as text, joined by line feeds, null as ``~``.

    Null is a key and a value of its own: it equals null only and is the
    smallest key. Where a snapshot repeats a key, its rows pair one by one in
    the order of their digests and the surplus goes on to the content pairs;
    repeated rows are rows of their own. Values are compared whole by a 128-bit
    digest of their text. Other columns of either table are ignored; empty
    tables give inserts or deletes only.
    """
    both = slim_rows(earlier, OLD, key, columns).unionAll(slim_rows(later, NEW, key, columns))
    by_key = paired_rows(materialise(both, "snapshot-rows"), key_order, "snapshot-keys")
    met = by_key.where("is_old and is_new")
    alone = by_key.where("not (is_old and is_new)").select(
        F.when(F.col("is_old"), OLD).otherwise(NEW).alias("side"), F.coalesce("old_key", "key").alias("key"),
        F.coalesce("old_content", "content").alias("content"), "row_sha256",
    )
    by_content = paired_rows(alone, content_order, "snapshot-contents")
    differs = [F.when(F.substring("old_content", 1 + DIGEST * i, DIGEST) != F.substring("content", 1 + DIGEST * i, DIGEST), c) for i, c in enumerate(columns)]
    changed = F.coalesce(F.concat_ws(",", *differs), F.lit(""))
    kept = met.withColumn("op", F.when(F.col("old_content") == F.col("content"), "same").otherwise("update"))
    rest = by_content.withColumn("op", F.when(F.col("is_old") & F.col("is_new"), "rekey").when(F.col("is_new"), "insert").otherwise("delete"))
    return kept.unionAll(rest).select(
        F.when(F.col("is_new"), F.col("key")).otherwise(F.col("old_key")).alias("key"), "old_key", "op", changed.alias("changed"), "row_sha256"
    )


def later_snapshot(docs: DataFrame) -> DataFrame:
    """The snapshot of the contract: what happens to a row depends on the CRC-32 of its decimal ``doc_id`` modulo 10.

    0 drops it, 1 appends ``+`` to the text, 2 swaps ``lang`` and ``source``, 3
    and 4 change the key to ``-1 - key`` (4 sets ``source`` null too), 5 adds a
    copy under such a key. Rows without id stay as they are.
    """
    docs = own_columns(docs, ["case_", "copy_"])
    case = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10, F.lit(9))
    marked = docs.withColumn("case_", case).where("case_ != 0")
    marked = marked.withColumn("copy_", F.explode(F.when(F.col("case_") == 5, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    moved = F.col("case_").isin(3, 4) | F.col("copy_")
    return marked.select(
        F.when(moved, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(F.col("case_") == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(F.col("case_") == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("case_") == 2, F.col("lang")).when(F.col("case_") == 4, F.lit(None)).otherwise(F.col("source")).alias("source"),
    )
