"""Near-duplicates by improved consistent weighted sampling.

Texts are bags of five-word shingles weighted by TF-IDF. A signature of
weighted samples is cut into bands. Texts that share a band first meet one
leader of the bucket; where members are left in different classes, these are
compared with all members in blocks. Each comparison is the weighted Jaccard
similarity of the whole texts; linked texts form classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.llm import sieve
from gleanwork.llm._shared import bound_batches, byte_values, materialise, own_columns
from gleanwork.llm.counters import summed_counters
from gleanwork.llm.words import mixed, row_terms, run_hashes, small_pieces, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 6
#: Document frequencies are counted in this many hashed counters, whatever the corpus.
SLOT_BITS = 20
#: Shingles in fewer than this share of texts, or this many, have full weight; with the floor
#: below, the commonest ones keep three quarters of it, so that large groups of
#: near copies, which make their own shingles common, stay alike.
RARE_SHARE = 1 / 1000
RARE_TEXTS = 10
FLOOR = 3.0
TABLE_BITS = 16
EXPECTED = 24
#: Members of a bucket, and bytes of their texts, that a block holds on average.
BLOCK_MEMBERS, BLOCK_BYTES = 512, 4 << 20
#: Shingles of a block whose columns are multiplied at a time.
STRIPE = 2048


# --- document frequencies -------------------------------------------------


def shingle_terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row, 48-bit shingle, count) by pieces of a text column."""
    for first, part in small_pieces(column):
        rows, terms, counts = row_terms(*run_hashes(*word_hashes(part), SHINGLE))
        yield first, len(part), rows, terms, counts


def slot_of(terms: np.ndarray) -> np.ndarray:
    return (terms & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def frequency_table(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Weights of all shingle slots, as float32.

    Each task counts all its texts into 2**20 counters. The usual load of a
    counter, which comes from unrelated shingles, is taken off before a weight
    is made of it.
    """
    slots = 1 << SLOT_BITS

    def count(table: np.ndarray, batch: pa.RecordBatch) -> None:
        for _, _, _, terms, _ in shingle_terms(batch.column(0)):
            table += np.bincount(slot_of(terms), minlength=slots)

    return slot_weights(*summed_counters(docs.select(F.col(text_col).cast("string")), slots, count, "shingle-slots"))


def slot_weights(table: np.ndarray, texts: int) -> np.ndarray:
    """Smoothed inverse document frequency of each slot, between 3/4 and 1."""
    rare = max(RARE_TEXTS, texts * RARE_SHARE)
    load = float(np.median(table)) if len(table) else 0.0
    found = np.maximum(table - load, rare)
    found = np.where(found > 2 * rare, found, rare)  # less may be chance
    idf = np.log(max(texts, 1) / np.minimum(found, max(texts, 1))) / np.log(max(texts / rare, 2.0))
    return ((FLOOR + np.clip(idf, 0, 1)) / (FLOOR + 1)).astype(np.float32)


# --- signatures -----------------------------------------------------------


@cache
def sample_table(seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(r, ln c, b, least cost at weight 1) of each draw, ascending by the last.

    A hash of (shingle, sample) picks a draw. As the least cost of a draw with
    weight w is ln c - r - ln w, only shingles that pick an early draw can win
    a sample; the others are left out once a winner proves that they cannot.
    """
    n = 1 << TABLE_BITS
    rng = np.random.default_rng(seed)
    r, c, b = rng.gamma(2.0, 1.0, n), rng.gamma(2.0, 1.0, n), rng.random(n)
    least = np.log(c) - r
    order = np.argsort(least)
    return r[order].astype(np.float32), np.log(c)[order].astype(np.float32), b[order].astype(np.float32), least[order].astype(np.float32)


@cache
def sample_keys(samples: int, seed: int = 6) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, samples, dtype=np.uint32), rng.integers(0, 1 << 31, samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def winners(u: np.ndarray, log_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cost and identity of shingles in one sample; ``u`` is their hash in it."""
    r, log_c, b, _ = sample_table()
    row = u >> np.uint32(32 - TABLE_BITS)
    level = np.floor(log_w / r[row] + b[row])
    cost = log_c[row] - r[row] * (level - b[row] + np.float32(1))
    u = (u ^ (u >> np.uint32(15))) * np.uint32(0x846CA68B)
    return cost, (u ^ (u >> np.uint32(16))) + level.astype(np.int32).astype(np.uint32) * np.uint32(0x85EBCA6B)


def ordered(cost: np.ndarray, identity: np.ndarray) -> np.ndarray:
    """uint64 that sorts by cost, then identity."""
    bits = np.ascontiguousarray(cost, np.float32).view(np.uint32)
    bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
    return (bits.astype(np.uint64) << np.uint64(32)) | identity


def weighted_samples(rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_rows: int, samples: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (n_rows, samples) of rows of sorted (row, term) pairs; rows without terms are 0."""
    out = np.zeros((n_rows, samples), np.uint32)
    if not len(rows):
        return out
    _, _, _, least = sample_table()
    size = 1 << TABLE_BITS
    e = (mixed(terms) >> np.uint64(32)).astype(np.uint32)
    log_w = np.log(weights).astype(np.float32)
    sizes = np.bincount(rows, minlength=n_rows)
    present = np.flatnonzero(sizes)
    starts = np.cumsum(sizes) - sizes
    top = np.full(n_rows, -np.inf, np.float32)
    top[present] = np.maximum.reduceat(log_w, starts[present])
    limit = np.minimum(size, np.maximum(16, size * EXPECTED // np.maximum(sizes, 1)))
    # beyond the limit no shingle of the row costs less than this
    bound = np.where(limit < size, least[np.minimum(limit, size - 1)] - top, np.inf)
    bar = np.where(limit < size, (limit << (32 - TABLE_BITS)) - 1, (1 << 32) - 1).astype(np.uint32)[rows]
    add, factor = sample_keys(samples)
    u, mask = np.empty_like(e), np.empty(len(e), bool)
    for k in range(samples):
        np.multiply(e, factor[k], out=u)
        u += add[k]
        np.less_equal(u, bar, out=mask)
        at = np.flatnonzero(mask)
        best = np.full(n_rows, np.uint64(0xFFFFFFFFFFFFFFFF))
        if len(at):
            key = ordered(*winners(u[at], log_w[at]))
            r = rows[at]
            first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            best[r[first]] = np.minimum.reduceat(key, first)
        # rows whose winner does not prove itself are done in full
        proven = best < ordered(bound.astype(np.float32), np.zeros(n_rows, np.uint32))
        open_rows = present[~proven[present]]
        if len(open_rows):
            flag = np.zeros(n_rows, bool)
            flag[open_rows] = True
            at = np.flatnonzero(flag[rows])
            key = ordered(*winners(u[at], log_w[at]))
            best[open_rows] = np.minimum.reduceat(key, np.cumsum(sizes[open_rows]) - sizes[open_rows])
        out[present, k] = best[present].astype(np.uint32)
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(rows, bands) 64-bit keys of the bands."""
    n, samples = signature.shape
    parts = signature.reshape(n, bands, samples // bands).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), (n, bands)).copy()
    for i in range(parts.shape[2]):
        h = mixed(h ^ parts[:, :, i]) * np.uint64(0x9FB21C651E98DF25)
    return mixed(h)


def text_node(data: bytes) -> bytes:
    return hashlib.md5(data, usedforsecurity=False).digest()


def banded(docs: DataFrame, table) -> DataFrame:  # noqa: ANN001
    """``doc_id, node, size, bands`` of each row, the size in bytes; texts without words have no bands."""
    list_type = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = table.value
        for batch in batches:
            text = batch.column(1)
            made: list = []
            for _, n, rows, terms, counts in shingle_terms(text):
                weights = counts * weight[slot_of(terms)]
                keys = band_keys(weighted_samples(rows, terms, weights, n)).view(np.int64)
                filled = np.bincount(rows, minlength=n) > 0
                made += [k if f else None for k, f in zip(keys, filled.tolist(), strict=True)]
            data = byte_values(text)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "node": pa.array(map(text_node, data), pa.binary()),
                "size": pa.array(map(len, data), pa.int64()), "bands": pa.array(made, list_type),
            })

    return docs.mapInArrow(run, "doc_id long, node binary, size long, bands array<long>")


def sieved(docs: DataFrame, bits) -> DataFrame:  # noqa: ANN001
    """``doc_id, text, node`` of the rows whose text may be wanted; only these are moved to the join that decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [text_node(x) for x in byte_values(batch.column(1))]
            if nodes:
                hit = pa.array(sieve.passes(bits.value, nodes))
                yield batch.append_column("node", pa.array(nodes, pa.binary())).filter(hit)

    return docs.mapInArrow(run, "doc_id long, text string, node binary")


# --- verification ---------------------------------------------------------


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two bags of sorted terms and weights."""
    terms, weights = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(terms, kind="stable")
    terms, weights = terms[order], weights[order]
    same = np.flatnonzero(terms[1:] == terms[:-1])
    shared = float(np.minimum(weights[same], weights[same + 1]).sum())
    total = float(weights.sum()) - shared
    return shared / total if total else 0.0


def bags(texts: pa.Array, weight: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted shingles and their weights of each text."""
    found = []
    for _, n, rows, terms, counts in shingle_terms(texts):
        w = counts * weight[slot_of(terms)].astype(np.float64)
        cut = np.searchsorted(rows, np.arange(n + 1))
        found += [(terms[x:y], w[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
    return found


def verified(pairs: DataFrame, texts: DataFrame, table, threshold: float) -> DataFrame:  # noqa: ANN001
    """Those of the pairs ``a, b`` of ids that are similar; ``texts`` has ``id, text`` once each."""
    met = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    met = met.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = table.value
        held: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}  # of leaders, which come many times
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            a = batch.column(0).to_pylist()
            wanted: dict[bytes, int] = {}
            for i, node in enumerate(a):
                if node not in held:
                    wanted.setdefault(node, i)
            fresh = dict(zip(wanted, bags(batch.column(2).take(pa.array(list(wanted.values()), pa.int64())), weight), strict=True))
            similar = [weighted_jaccard(fresh.get(x) or held[x], y) >= threshold for x, y in zip(a, bags(batch.column(3), weight), strict=True)]
            held = {k: v for k, v in (held | fresh).items() if k == a[-1]}  # rows of one node follow each other
            yield batch.select(["a", "b"]).filter(pa.array(similar, pa.bool_()))

    return met.mapInArrow(run, "a binary, b binary")


def shared_weights(rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Weight that each row of ``left`` shares with each row of ``right``.

    The lesser of two counts of a shingle is the sum of the steps between the
    counts that occur, up to those that both rows reach. So every (shingle,
    step) is a column that a row has or has not, and the shared weights are a
    product of matrices, a stripe of columns at a time.
    """
    order = np.lexsort((counts, terms))
    t, c = terms[order], counts[order]
    new_term = np.append(True, t[1:] != t[:-1])
    new_step = new_term | np.append(True, c[1:] != c[:-1])
    step = np.cumsum(new_step) - 1
    first = np.maximum.accumulate(np.where(new_term, step, 0))  # first step of the entry's shingle
    at = np.flatnonzero(new_step)
    before = np.append(0, c[at[:-1]])
    size = (c[at] - np.where(new_term[at], 0, before)) * weight[slot_of(t[at])].astype(np.float64)
    reach = step - first + 1
    row = np.repeat(rows[order], reach)
    column = np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat(first, reach)
    often = np.bincount(column, minlength=len(at)) > 1
    row, column = row[often[column]], column[often[column]]
    column = (np.cumsum(often) - 1)[column]
    size = size[often]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)))
    n = int(max(left.max(), right.max())) + 1
    for begin in range(0, len(size), STRIPE):
        upto = min(begin + STRIPE, len(size))
        x, y = np.searchsorted(column, [begin, upto])
        has = np.zeros((n, upto - begin))
        has[row[x:y], column[x:y] - begin] = 1
        out += (has[left] * size[begin:upto]) @ has[right].T
    return out


def linked_roots(a: list[bytes], b: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Fewest of the links that keep the same classes together."""
    parent: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while (y := parent.get(x, x)) != x:
            parent[x] = parent.get(y, y)
            x = y
        return x

    found = []
    for x, y in zip(a, b, strict=True):
        p, q = top(x), top(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            found.append((x, y))
    return found


def block_links(block: pa.Table, weight: np.ndarray, threshold: float) -> list[tuple[bytes, bytes]]:
    """Links of classes by all pairs of a block (``root, few, many, text``) with a row of ``few`` and one of ``many``."""
    column = block.column("text").combine_chunks()
    parts = list(shingle_terms(column))
    rows = np.concatenate([first + r for first, _, r, _, _ in parts])
    terms, counts = np.concatenate([t for *_, t, _ in parts]), np.concatenate([c for *_, c in parts])
    few = np.flatnonzero(block.column("few").to_numpy())
    many = np.flatnonzero(block.column("many").to_numpy())
    if not len(few) or not len(many):
        return []
    total = np.bincount(rows, counts * weight[slot_of(terms)].astype(np.float64), block.num_rows)
    shared = shared_weights(rows, terms, counts, weight, few, many)
    root = block.column("root").to_pylist()
    number = {x: i for i, x in enumerate(dict.fromkeys(root))}
    of = np.array([number[x] for x in root])
    alike = (shared >= threshold * (total[few][:, None] + total[many][None, :] - shared)) & (of[few][:, None] != of[many][None, :])
    x, y = np.nonzero(alike)
    return linked_roots([root[i] for i in few[x]], [root[i] for i in many[y]])


# --- classes --------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of the nodes of ``links`` (``a, b``); the root is the least node of its component.

    Alternates rounds that hang each node's larger neighbours, then its
    smaller ones, under the least; each round is a distributed aggregation
    whose result is written, and it ends when nothing changes.
    """
    edges = materialise(links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if state == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = state
        both = edges.select("hi", "lo").union(edges.select(F.col("lo"), F.col("hi")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m"))
        near = both.join(least, "hi").select("hi", "lo", F.least("hi", "m").alias("m"))
        large = near.where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        large = materialise(large, "large-star")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = materialise(moved.union(low.select("hi", F.col("m").alias("lo"))).distinct(), "small-star")


def node_id(least: Column, node: Column) -> Column:
    """25 bytes that sort by the least ``doc_id`` of a text (null last), then by its digest, so the least id of a class names it."""
    shifted = F.lpad(F.hex(F.coalesce(least, F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.when(least.isNull(), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), F.unhex(shifted), node)


def least_of(node: Column) -> Column:
    value = F.conv(F.hex(F.substring(node, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", value)


def digest_of(node: Column) -> Column:
    return F.substring(node, 10, 16)


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after ``links`` (``a, b``) of roots have joined whole classes."""
    over = components(links).select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    named = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root"))
    known = roots.union(named.join(roots.select("node"), "node", "left_anti"))
    known = known.join(over, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    return materialise(known, "roots")


def open_blocks(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, i, j, id, root, few, many``: blocks in which all open pairs of the buckets (``key, id, size, members``) meet.

    Members of a bucket's commonest class need not meet each other. So the
    others (few) are dealt into blocks i, all members into blocks j, and
    each few meets each many in block (i, j) of its key. A bucket of one
    block has each member once.
    """
    now = buckets.where("members > 2").join(roots, F.col("id") == F.col("node"), "left").select("key", "id", "size", F.coalesce("root", "id").alias("root"))
    sizes = now.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    main = F.max(F.struct("n", "root"))
    found = sizes.groupBy("key").agg(main.alias("top"), F.count("*").alias("classes"), F.sum("n").alias("members"), F.sum("bytes").alias("bytes")).where("classes > 1")
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK_MEMBERS, F.col("bytes") / BLOCK_BYTES)).cast("int")
    found = found.select("key", F.col("top.root").alias("main"), blocks.alias("js"), (1 - F.col("top.n") / F.col("members")).alias("share"))
    found = found.withColumn("is", F.greatest(F.lit(1), F.ceil(F.col("js") * F.col("share"))).cast("int"))
    now = materialise(now.join(found, "key").select("key", "id", "root", "js", "is", (F.col("root") != F.col("main")).alias("other")), "open-members")
    place = lambda n, seed: F.pmod(F.xxhash64("id", "key", F.lit(seed)), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    many = now.select("key", upto("is").alias("i"), place("js", 0).alias("j"), "id", "root", (F.col("other") & (F.col("js") == 1)).alias("few"), F.lit(True).alias("many"))
    few = now.where("other and js > 1").select("key", place("is", 1).alias("i"), upto("js").alias("j"), "id", "root", F.lit(True).alias("few"), F.lit(False).alias("many"))
    return many.union(few)


def met_in_full(buckets: DataFrame, roots: DataFrame, texts: DataFrame, table, threshold: float) -> DataFrame:  # noqa: ANN001
    """``roots`` when any two members of a bucket are of one class or have been compared."""
    blocks = open_blocks(buckets, roots).join(texts, "id").select("key", "i", "j", "root", "few", "many", "text")

    def compare(block: pa.Table) -> pa.Table:
        found = block_links(block, table.value, threshold)
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    late = blocks.groupBy("key", "i", "j").applyInArrow(compare, "a binary, b binary").distinct()
    late = materialise(late, "late-links")
    # links found late join whole classes, so only those are followed again
    return roots if late.isEmpty() else joined_roots(roots, late)


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id, is_kept`` of each row of ``docs`` (``doc_id, text``).

    Rows of one class have equal texts or are linked by pairs of weighted
    Jaccard similarity ``threshold`` or more; ``class_id`` is the least
    ``doc_id`` of the class (null if all its ids are null). Equal texts are one
    node, so copies are never paired. Null counts as the empty text; all texts
    without words are near only their equals; repeated rows share their class.
    ``is_kept`` marks the rows of one text of the class, those with the least
    id. Whole texts count, however long; an empty table gives an empty result;
    other columns of ``docs`` are ignored. The classes are those of all pairs
    that share a band: each bucket is compared with one leader, and members
    left in different classes with all others of the bucket, in blocks of
    bounded size. Comparisons follow the number of members where buckets are
    of one class, and the number of pairs of different classes elsewhere.
    """
    return classes(docs, threshold).drop("node")


def classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``near_duplicates`` with their texts' 16-byte digests (``node``)."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = spark.sparkContext.broadcast(frequency_table(rows))
    marked = materialise(banded(rows, table), "bands")
    # one row of each text stands for its copies, whose bands are the same
    nodes = marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = nodes.select("node", node_id(F.col("least"), F.col("node")).alias("id"), "size", "bands")
    buckets = nodes.where("bands is not null").select("id", "size", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("members"), F.min_by("id", F.xxhash64("id")).alias("leader")).where("members > 1")
    buckets = materialise(buckets.join(shared, "key"), "buckets")
    wanted = buckets.select("id").distinct()
    wanted = materialise(wanted.select(digest_of(F.col("id")).alias("node"), least_of(F.col("id")).alias("least"), "id"), "wanted")
    named = sieved(rows, spark.sparkContext.broadcast(sieve.made(wanted.select("node"), wanted.count())))
    # the wanted nodes grow with the corpus, so they are never broadcast: the plan is the same at every size
    texts = named.join(wanted.hint("merge"), "node").where(F.col("doc_id").eqNullSafe(F.col("least"))).select("id", "text").dropDuplicates(["id"])
    texts = materialise(texts, "near-texts")
    meetings = buckets.where("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    roots = components(materialise(verified(meetings, texts, table, threshold), "verified"))
    roots = met_in_full(buckets, roots, texts, table, threshold)
    named = nodes.select("node", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("node", F.coalesce("root", "id").alias("root"))
    out = marked.select("doc_id", "node").join(named, "node").withColumn("class_id", least_of(F.col("root")))
    kept = (F.col("node") == digest_of(F.col("root"))) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return materialise(out.select("doc_id", "node", "class_id", kept.alias("is_kept")), "near-classes")


def drop_near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row of each class, the one with the least ``doc_id``; same columns as ``docs``.

    Of repeated rows one stays, and of a class without ids one row.
    """
    names = docs.columns
    held = own_columns(docs, ["node"])
    kept = classes(held.select("doc_id", "text"), threshold).where("is_kept").select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"))
    once = kept.distinct()
    repeated = kept.count() != once.count()
    node = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    met = held.withColumn("_own", node).join(once, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_node"))).drop("_id", "_node")
    if repeated:
        met = met.dropDuplicates(["doc_id", "_own"])
    return met.drop("_own").toDF(*names)
