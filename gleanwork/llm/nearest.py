"""Nearest neighbours by cosine: probed lists, and adaptive scans over the columns of rotated vectors.

An index is fitted on a bounded sample: centroids that divide the vectors into
lists, a random rotation, and the number of lists that a query probes, which is
the smallest that finds the wanted share of the sample's own neighbours. Every
row is put into the list of its nearest centroid.

Lists are searched in blocks of candidates and of queries. A block's vectors
are rotated and compared column block by column block. After each, the distance
seen so far, scaled up to all columns, is held against the query's bound: a
candidate that lies beyond it by more than the test's margin is abandoned.
Bounds come from the sample first and shrink with what a block finds. What
survives all columns is measured on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.llm._shared import bound_batches, materialise

#: Rows and bytes of the sample at most (on average), and lists.
SAMPLE_ROWS, SAMPLE_BYTES, MAX_LISTS = 32_768, 64 << 20, 4096
#: Share of the sample's neighbours that the probed lists hold, and queries it is measured with.
RECALL, TRIALS = 0.98, 400
#: Rows of a block of candidates and of queries.
CANDIDATES, QUERIES = 16_384, 2_048
#: Columns that are compared before a test, and the margin of the test in standard deviations.
COLUMNS, MARGIN = 16, 2.1
#: Candidates between two updates of the bounds; share of pairs below which survivors are followed one by one.
CHUNK, SPARSE = 2_048, 0.12
FOUND = "query_id long, vec_id long, score double"


class Index(NamedTuple):
    rotation: np.ndarray
    centroids: np.ndarray
    sample_ids: np.ndarray
    sample: np.ndarray
    probes: int


def usable(vector: Column) -> Column:
    """No null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    n = len(column)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish; cosines stay as they are."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True, initial=0))
    return np.ldexp(vectors, -exponent)


def units(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return (vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of scaled doubles, pair by pair."""
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def rotation_matrix(size: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 12) -> np.ndarray:
    """Unit centroids of unit vectors; a centroid without vectors keeps its place."""
    centroids = sample[np.sort(np.random.default_rng(seed).choice(len(sample), k, replace=False))].copy()
    for _ in range(rounds):
        own = nearest_centroids(sample, centroids)
        order = np.argsort(own, kind="stable")
        begin = np.searchsorted(own[order], np.arange(k))
        held = np.flatnonzero(np.bincount(own, minlength=k))
        total = np.add.reduceat(sample[order], begin[held], axis=0)
        length = np.sqrt(np.einsum("ij,ij->i", total, total))
        good = length > 1e-6
        centroids[held[good]] = total[good] / length[good, None]
    return centroids


def nearest_centroids(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(vectors[i : i + 4096] @ centroids.T, axis=1) for i in range(0, len(vectors), 4096)] or [np.zeros(0, np.int64)])


def probes_for(sample: np.ndarray, centroids: np.ndarray, k: int) -> int:
    """Lists to probe so that they hold the wanted share of the neighbours of some sampled vectors among all others."""
    trials = np.unique(np.linspace(0, len(sample) - 1, TRIALS).astype(int))
    own = nearest_centroids(sample, centroids)
    likeness = sample[trials] @ sample.T
    likeness[np.arange(len(trials)), trials] = -np.inf
    best = np.argsort(-likeness, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    order = np.argsort(-(sample[trials] @ centroids.T), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(centroids))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(rank, own[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 1 if len(needed) else 1


def fit_index(vectors: DataFrame, rows: int, size: int, k: int) -> Index:
    """Fit on a sample of ``SAMPLE_ROWS`` rows (all, if fewer) of at most ``SAMPLE_BYTES``."""
    wanted = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * size)))
    table = (vectors if rows <= wanted else vectors.sample(wanted / rows, seed=13)).toArrow()
    sample = matrix(table["vector"])
    if not len(sample):
        return Index(rotation_matrix(size), np.zeros((1, size), np.float32), np.zeros(0, np.int64), np.zeros((0, size)), 1)
    one = units(sample)
    centroids = fit_centroids(one, max(1, min(MAX_LISTS, int(rows**0.5), len(sample))))
    return Index(rotation_matrix(size), centroids, table["vec_id"].to_numpy(), sample, probes_for(one, centroids, k))


def firsts(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each query, ties to the smaller id, repeated ids once."""
    order = np.lexsort((ids, -score, query))
    q, i = query[order], ids[order]
    again = np.zeros(len(q), bool)
    again[1:] = (q[1:] == q[:-1]) & (i[1:] == i[:-1]) & (score[order][1:] == score[order][:-1])
    order, q = order[~again], q[~again]
    begin = np.flatnonzero(np.append(True, q[1:] != q[:-1])[: len(q)])
    place = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
    return order[place < k]


def survivors(q: np.ndarray, c: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rotated queries and candidates that no test abandons, by column blocks.

    Squared distances of unit vectors grow with each block of columns. Scaled
    by all columns over those seen they estimate the whole distance; the margin
    shrinks with the square root of the columns seen and ends at rounding.
    """
    size = q.shape[1]
    seen = np.zeros((len(q), len(c)), np.float32)
    at_q = at_c = so_far = None
    for begin in range(0, size, COLUMNS):
        end = min(begin + COLUMNS, size)
        own_q, own_c = q[:, begin:end], c[:, begin:end]
        slack = (1 + MARGIN / end**0.5) ** 2 * end / size if end < size else 1.0
        limit = (bound * slack + 1e-5).astype(np.float32)
        if at_q is None:
            seen += np.einsum("ij,ij->i", own_q, own_q)[:, None] + np.einsum("ij,ij->i", own_c, own_c)[None, :] - 2 * (own_q @ own_c.T)
            stays = seen <= limit[:, None]
            if end == size or np.count_nonzero(stays) < SPARSE * stays.size:
                at_q, at_c = np.nonzero(stays)
                so_far = seen[at_q, at_c]
        else:
            step = own_q[at_q] - own_c[at_c]
            so_far = so_far + np.einsum("ij,ij->i", step, step)
            stays = so_far <= limit[at_q]
            at_q, at_c, so_far = at_q[stays], at_c[stays], so_far[stays]
    return at_q, at_c


def search_block(query_ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, ids: np.ndarray, candidates: np.ndarray, rotation: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to k nearest of each query among the candidates that lie within its bound: places of queries, ids, cosines."""
    rotated_q, rotated_c = units(queries) @ rotation, units(candidates) @ rotation
    queries, candidates = scaled(queries), scaled(candidates)
    place, found, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    bound = bound.copy()
    for begin in range(0, len(ids), CHUNK):
        at_q, at_c = survivors(rotated_q, rotated_c[begin : begin + CHUNK], bound)
        at_c = at_c + begin
        other = query_ids[at_q] != ids[at_c]
        at_q, at_c = at_q[other], at_c[other]
        for i in range(0, len(at_q), 1 << 17):
            own_q, own_c = at_q[i : i + (1 << 17)], at_c[i : i + (1 << 17)]
            place, found = np.append(place, own_q), np.append(found, ids[own_c])
            score = np.append(score, cosines(queries[own_q], candidates[own_c]))
            best = firsts(place, found, score, k)
            place, found, score = place[best], found[best], score[best]
        held = np.bincount(place, minlength=len(bound))
        full = np.flatnonzero(held == k)
        last = np.cumsum(held)[full] - 1  # entries are by query, best first
        bound[full] = np.minimum(bound[full], 2 - 2 * score[last])
    return place, found, score


def sampled_neighbours(query_ids: np.ndarray, queries: np.ndarray, index: Index, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sample's k nearest (places of queries, ids, cosines), and the bound that they give."""
    unbound = np.full(len(queries), 5.0)
    if not len(index.sample_ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), unbound
    place, found, score = search_block(query_ids, queries, unbound, index.sample_ids, index.sample, index.rotation, k)
    held = np.bincount(place, minlength=len(queries))
    full = np.flatnonzero(held == k)
    unbound[full] = 2 - 2 * score[np.cumsum(held)[full] - 1]
    return place, found, score, unbound


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: of each query row the k rows of greatest cosine found, ties to the smaller id.

    All rows are candidates of all queries but for those of the query's own id.
    Rows without id, and vectors that are null, zero, or hold null or
    non-finite components take no part, and no more do vectors of another length than
    most have (ties: the longer), as they have no cosine with them. Rows that
    repeat an id count once as candidates (the nearest), and as queries with
    the smallest vector. Empty tables give no rows. Other columns are ignored.

    The sample's neighbours are among the results, so a query has k of them
    whenever there are so many. The lists probed hold ``RECALL`` of the
    neighbours of sampled vectors. Lists are split into blocks by a hash of the
    id, the queries of a list as well, so no task holds a large list.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), is_query.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == common.n)
    index = spark.sparkContext.broadcast(fit_index(rows.select("vec_id", "vector"), common["count"], common.n, k))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = index.value.centroids
        for batch in batches:
            own = nearest_centroids(units(matrix(batch.column("vector"))), centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=[*batch.schema.names, "list"])

    kind = dict(rows.dtypes)["vector"]
    stored = materialise(rows.mapInArrow(listed, f"vec_id long, vector {kind}, asks boolean, list int"), "listed-vectors")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            ids, queries = batch.column("query_id").to_numpy(), matrix(batch.column("vector"))
            place, found, score, bound = sampled_neighbours(ids, queries, own, k)
            order = np.argsort(-(units(queries) @ own.centroids.T), axis=1, kind="stable")[:, : own.probes]
            cut = np.searchsorted(place, np.arange(len(ids) + 1))
            near = [[{"vec_id": v, "score": s} for v, s in zip(found[i:j].tolist(), score[i:j].tolist(), strict=True)] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id"), batch.column("vector"), pa.array(bound), pa.array(order.tolist(), pa.list_(pa.int32())), pa.array(near, pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])))],
                names=["query_id", "vector", "bound", "lists", "near"],
            )

    queries = stored.where("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))
    queries = materialise(queries.mapInArrow(asked, f"query_id long, vector {kind}, bound double, lists array<int>, near array<struct<vec_id: long, score: double>>"), "probing-queries")
    probing = queries.select("query_id", "vector", "bound", F.explode("lists").alias("list"))
    # a row for each list, of which there are MAX_LISTS at most
    sizes = stored.groupBy("list").agg(F.ceil(F.count("*") / CANDIDATES).cast("int").alias("n_c"))
    sizes = sizes.join(probing.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("n_q")), "list")
    sizes = F.broadcast(materialise(sizes, "list-sizes"))
    part = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = stored.join(sizes, "list").select("list", part("vec_id", "n_c").alias("c"), every("n_q").alias("q"), "vec_id", "vector")
    right = probing.join(sizes, "list").select(F.col("list").alias("list_q"), every("n_c").alias("c_q"), part("query_id", "n_q").alias("q_q"), "query_id", "vector", "bound")

    def searched(candidates: pa.Table, asking: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        ids = asking["query_id"].to_numpy()
        if len(candidates) and len(asking):
            found = search_block(ids, matrix(asking["vector"]), asking["bound"].to_numpy(), candidates["vec_id"].to_numpy(), matrix(candidates["vector"]), index.value.rotation, k)
        return pa.table({"query_id": pa.array(ids[found[0]], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    found = left.groupBy("list", "c", "q").cogroup(right.groupBy("list_q", "c_q", "q_q")).applyInArrow(searched, FOUND)
    near = queries.select("query_id", F.explode("near").alias("n")).select("query_id", "n.vec_id", "n.score")
    best = found.unionAll(near).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return top_ranks(best, k)


def top_ranks(best: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
