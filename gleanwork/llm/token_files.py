"""Token-id files in Simple-8b coding.

A 64-bit word holds a 4-bit selector and 60 bits of data: the selector says
how many ids of how many bits follow. Ids too long for that are escaped: a
word with selector 15 is followed by a word that is the id itself. Ids are
coded in blocks of 4096 with a table of word offsets, so any block decodes
alone and all of a file decode at once, vectorised.

File, little-endian: ``GWS8``, u32 version, u64 documents, u64 ids, u64 blocks,
u64 words; i64 document ids; u8 whether a document id is null; u32 ids of each
document; u64 first word of each block; the words.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanwork.llm._shared import bound_batches, byte_values, materialise, new_folder, pieces, read_bytes, write_bytes
from gleanwork.llm.bpe import encoder

#: Ids and bits of each selector; 15 is the escape.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15
BLOCK = 4096
TOGETHER = 96
MAGIC = b"GWS8"
HEADER = struct.Struct("<4sIQQQQ")
FILE_IDS = 2 << 20


def choices(ids: np.ndarray) -> np.ndarray:
    """Selector at each place of each block: the first whose ids all fit. Ids after the block's end count as fitting."""
    blocks, n = ids.shape
    chosen = np.full(ids.shape, ESCAPE, np.int8)
    top = int(ids.max(initial=0))
    for s in range(ESCAPE - 1, -1, -1):
        limit, count = 1 << int(BITS[s]), int(COUNTS[s])
        if top < limit:
            chosen[:] = s
            continue
        fit = np.ones((blocks, n + 256), bool)
        np.less(ids, np.uint64(limit), out=fit[:, :n])
        width = 1  # widened to the selector's count by doubling
        while width < count and fit.any():
            step = min(width, count - width)
            fit[:, : n + 256 - step] &= fit[:, step:].copy()
            width += step
        chosen[fit[:, :n]] = s
    return chosen


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of each block. Blocks are packed a few at a time, so that the work stays in the cache."""
    words, offsets, base = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0
    for i in range(0, len(ids), TOGETHER * BLOCK):
        w, o = pack_blocks(ids[i : i + TOGETHER * BLOCK])
        words.append(w)
        offsets.append(o + np.uint64(base))
        base += len(w)
    return np.concatenate(words), np.concatenate(offsets)


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    wide = np.zeros((blocks, BLOCK + 240), np.uint64)
    full = n // BLOCK
    wide[:full, :BLOCK] = ids[: full * BLOCK].reshape(full, BLOCK)
    wide[full:, : n - full * BLOCK] = ids[full * BLOCK :]
    chosen = choices(wide[:, :BLOCK])
    step = COUNTS.astype(np.int32)[chosen].reshape(-1)
    base = np.arange(blocks, dtype=np.int64) * BLOCK
    end = np.minimum(base + BLOCK, n)
    at = base.copy()
    live = np.arange(blocks)
    walked = np.full((BLOCK, blocks), -1, np.int64)
    turn = 0
    while len(live):  # all blocks advance together
        now = at[live]
        walked[turn, live] = now
        now += step[now]
        at[live] = now
        if (now >= end[live]).any():
            live = live[now < end[live]]
        turn += 1
    place = walked[:turn].T.reshape(-1)
    place = place[place >= 0]
    block = place // BLOCK
    selector = chosen.reshape(-1)[place].astype(np.int64)
    size = 1 + (selector == ESCAPE)
    first = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    flat, source = wide.reshape(-1), place + block * 240
    for s in np.flatnonzero(np.bincount(selector, minlength=16)).tolist():
        mine = np.flatnonzero(selector == s)
        word = np.full(len(mine), s << 60, np.uint64)
        if s == ESCAPE:
            words[first[mine] + 1] = flat[source[mine]]
        elif BITS[s]:
            for i in range(int(COUNTS[s])):
                word |= flat[source[mine] + i] << np.uint64(i * int(BITS[s]))
        words[first[mine]] = word
    starts = np.searchsorted(block, np.arange(blocks))
    return words, first[starts].astype(np.uint64)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """All ids of a file."""
    parts, bounds = [np.zeros(0, np.uint64)], np.append(offsets, np.uint64(len(words))).astype(np.int64)
    for i in range(0, len(offsets), TOGETHER):
        a, b = int(bounds[i]), int(bounds[min(i + TOGETHER, len(offsets))])
        parts.append(unpack_blocks(words[a:b], bounds[i : min(i + TOGETHER, len(offsets))] - a, min(n - i * BLOCK, TOGETHER * BLOCK)))
    return np.concatenate(parts)


def unpack_blocks(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    stride = BLOCK + 240  # room for the padding of a block's last word
    out = np.zeros(len(offsets) * stride, np.uint64)
    if not len(offsets):
        return out[:0]
    selector = (words >> np.uint64(60)).astype(np.int8)
    # a word after an escape is data; escapes are rare, so they are walked
    escapes = np.flatnonzero(selector == ESCAPE)
    heads = np.arange(len(words))
    if len(escapes):
        data = np.zeros(len(words), bool)
        last = -1
        for e in escapes.tolist():
            if e != last:
                last = e + 1
                data[last] = True
        heads = heads[~data]
    sel = selector[heads]
    first = np.searchsorted(heads, offsets)  # of each block, among the heads
    step = COUNTS[sel]
    upto = np.cumsum(step) - step
    block = np.repeat(np.arange(len(offsets)), np.diff(np.append(first, len(heads))))
    place = block * stride + upto - upto[first][block]
    value = words[heads]
    for s in np.flatnonzero(np.bincount(sel, minlength=16)).tolist():
        mine = np.flatnonzero(sel == s)
        if s == ESCAPE:
            out[place[mine]] = words[heads[mine] + 1]
        elif BITS[s]:
            mask = np.uint64((1 << int(BITS[s])) - 1)
            to, word = place[mine], value[mine]
            for i in range(int(COUNTS[s])):
                out[to + i] = (word >> np.uint64(i * int(BITS[s]))) & mask
    return out.reshape(len(offsets), stride)[:, :BLOCK].reshape(-1)[:n]


def file_image(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words, offsets = pack(ids)
    head = HEADER.pack(MAGIC, 1, len(doc_ids), len(ids), len(offsets), len(words))
    return b"".join([
        head, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes(),
        np.array(lengths, "<u4").tobytes(), offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes(),
    ])


def read_image(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids of each document, and all ids."""
    magic, version, docs, n, blocks, size = HEADER.unpack_from(data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token file of this format")
    at = HEADER.size
    parts = []
    for kind, count in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u8", blocks), ("<u8", size)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    if at != len(data):
        raise ValueError("token file of another length than it states")
    ids, null, lengths, offsets, words = parts
    return [None if z else x for x, z in zip(ids.tolist(), null.tolist(), strict=True)], lengths.astype(np.int64), unpack(words, offsets, n)


MANIFEST = "part long, seq long, file string, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, path: str, end_id: int | None = None, folder: str | None = None) -> DataFrame:
    """Encode ``docs`` (``doc_id, text``) and write their ids in ascending ``doc_id`` order; returns the manifest.

    The texts are dealt by ranges of ``doc_id``, so tasks hold consecutive
    stretches of the order and write files of about two million ids (a longer
    document has a file of its own). Null ids come first; null texts are empty
    and hold only the end id; rows with equal ids are neighbours. Files appear
    whole, and the manifest lists those of successful tasks only.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = folder or new_folder(spark, "token-files")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        part = TaskContext.get().partitionId()
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        ids: list[np.ndarray] = []
        total = seq = 0

        def close() -> pa.RecordBatch:
            name = f"{folder}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.gws8"
            write_bytes(name, file_image(doc_ids, lengths, np.concatenate(ids)))
            made = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "seq": pa.array([seq], pa.int64()), "file": pa.array([name]), "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_ids": pa.array([total], pa.int64())})
            doc_ids.clear(), lengths.clear(), ids.clear()
            return made

        for batch in (x for b in batches for x in pieces(b, "text", 900_000)):
            for doc, found in zip(batch.column(0).to_pylist(), own.encode_all(byte_values(batch.column(1))), strict=True):
                if end_id is not None:
                    found = np.append(found, np.uint32(end_id))
                if doc_ids and total + len(found) > FILE_IDS:
                    yield close()
                    total, seq = 0, seq + 1
                doc_ids.append(doc)
                lengths.append(len(found))
                ids.append(found)
                total += len(found)
        if doc_ids:
            yield close()

    return materialise(rows.mapInArrow(run, MANIFEST), "token-manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row for each document of the files: ``doc_id, start, n_tokens, ids_crc32`` (and ``ids``).

    ``start`` counts the ids of all documents before it: sums over parts of
    the order, then over the files of a part, then inside a file.
    """
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.join(parts, F.col("part") == F.col("_part")).select("file", (F.col("_start") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("start"))
    files = files.repartition(max(1, min(manifest.count(), 4096)), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                doc_ids, lengths, ids = read_image(read_bytes(name))
                ids = ids.astype("<u4")
                ends = np.cumsum(lengths)
                stretches = list(zip((ends - lengths).tolist(), ends.tolist(), strict=True))
                columns = {
                    "doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(start + ends - lengths, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in stretches], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([ids[a:b].astype(np.int64) for a, b in stretches], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
