"""Language-model scoring by cross-entropy difference.

A target and a background bigram model are counted over the whole corpus.
They are matched: the same order, the same smoothing, and one vocabulary, the
distinct lower-case words of the corpus, by 64-bit hashes. A document's score
is the mean difference of its words' losses under the two models of all other
documents, so no document is scored by its own counts.

Counts are exact and grow with the corpus. Texts are kept as blocks of word
numbers. Each block sends its distinct words and bigrams, by ranges of their
hashes, to the tasks that sum a range over all blocks; these answer each block
with the sums for what it sent, in the order in which it was sent.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.llm import sieve
from gleanwork.llm._shared import bound_batches, materialise, own_columns
from gleanwork.llm.words import mixed, small_pieces, word_hashes

#: Weight of the bigram estimate; the rest is the unigram's, smoothed by one count spread over the vocabulary.
BIGRAM_WEIGHT = 0.6
#: Bytes of text of a block, one row at least.
BLOCK_BYTES = 8 << 20
#: Grams of blocks that a range has on average, at most, and the fewest ranges.
RANGE_GRAMS, MIN_RANGES = 2_000_000, 32
FIGURES = "n_words long, target_loss double, background_loss double, difference double"


def packed(values: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, of which the high ones are nearly empty."""
    rows = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize * (values.size // max(1, len(values))))
    return zlib.compress(np.ascontiguousarray(rows.T).tobytes(), 1)


def unpacked(data: bytes, kind: str, columns: int = 1) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    width = np.dtype(kind).itemsize * columns
    rows = np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).view(kind)
    return rows if columns > 1 else rows.ravel()


def coded(keys: np.ndarray, base: np.uint64) -> bytes:
    """Sorted keys from ``base`` on as their differences, in as few bytes as the largest needs."""
    steps = np.diff(keys, prepend=base)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def decoded(data: bytes, base: np.uint64) -> np.ndarray:
    width = data[0]
    steps = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) + base


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their rows of counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first, axis=0) if len(keys) else counts


def pair_hashes(hashes: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of each word with the one before it; a row's first word has none (-1)."""
    left = np.where(before >= 0, hashes[np.maximum(before, 0)], np.uint64(0))
    return mixed(mixed(left) + hashes[word] * np.uint64(0x9FB21C651E98DF25))


def words_before(word: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The word before each, or -1."""
    before = np.empty_like(word)
    before[1:] = word[:-1]
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    before[starts] = -1
    return before


class Block:
    """Texts as numbers of their distinct words."""

    def __init__(self, hashes: np.ndarray, word: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> None:
        self.hashes, self.word, self.lengths, self.target = hashes, word, lengths, target
        self.rows = np.repeat(np.arange(len(lengths)), lengths)
        self.before = words_before(word, lengths)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of distinct bigrams, and the number of each word's."""
        pairs = (self.before + 1).astype(np.int64) * (len(self.hashes) + 1) + self.word
        pairs, number = np.unique(pairs, return_inverse=True)
        before, word = np.divmod(pairs, len(self.hashes) + 1)
        hashes = pair_hashes(self.hashes, before - 1, word)
        order = np.argsort(hashes, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return hashes[order], place[number]

    def counts(self, number: np.ndarray, size: int) -> np.ndarray:
        """Columns: how often each gram occurs, and how often in target rows."""
        own = self.target[self.rows]
        return np.stack([np.bincount(number, minlength=size), np.bincount(number[own], minlength=size)], 1)


def blocks_of(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[Block, pa.Table]]:
    """Blocks of consecutive rows, and the rows' other columns."""
    held: list[tuple[np.ndarray, np.ndarray, pa.RecordBatch]] = []
    size = 0

    def close() -> tuple[Block, pa.Table]:
        hashes, word = np.unique(np.concatenate([h for h, _, _ in held]), return_inverse=True)
        rows = pa.Table.from_batches([b for _, _, b in held])
        target = rows.column(TARGET).fill_null(False).to_numpy().astype(bool)
        block = Block(hashes, word.astype(np.int64), np.concatenate([n for _, n, _ in held]), target)
        held.clear()
        return block, rows.drop_columns([TARGET])

    for batch in batches:
        at = batch.schema.get_field_index(text_col)
        others = batch.select([n for n in batch.schema.names if n not in (text_col, KEY)])
        for first, part in small_pieces(batch.column(at)):
            if held and size + part.nbytes > BLOCK_BYTES:
                yield close()
                size = 0
            hashes, counts = word_hashes(part)
            held.append((hashes, counts, others.slice(first, len(part))))
            size += part.nbytes
    if held:
        yield close()


#: Columns that the operator adds on its way: whether a row is of the target, and its id's digest.
TARGET, KEY = "_is_target", "_key"
BLOCKS = "block string, n_words long, n_target long, rows binary, hashes binary, word binary, lengths binary, target binary"
ARROW_BLOCKS = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in map(str.split, BLOCKS.split(", "))])


def written_blocks(docs: DataFrame, text_col: str, label: str, misses=None) -> DataFrame:  # noqa: ANN001
    """The blocks of a table, written: word numbers and the other columns, packed; with a sieve, of the rows that it stops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        if misses is not None:
            batches = (b.filter(pa.array(~held_by(misses.value, b))) for b in batches if b.num_rows)
        for seq, (block, rows) in enumerate(blocks_of((b for b in batches if b.num_rows), text_col)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows)
            yield pa.RecordBatch.from_pylist([{
                "block": f"{label}-{part}-{seq}", "n_words": len(block.word), "n_target": int(block.lengths[block.target].sum()),
                "rows": sink.getvalue().to_pybytes(), "hashes": block.hashes.tobytes(), "word": packed(block.word.astype("<u4")),
                "lengths": packed(block.lengths.astype("<i8")), "target": packed(block.target),
            }], ARROW_BLOCKS)

    return materialise(docs.mapInArrow(run, BLOCKS), f"lm-{label}")


def read_block(row: dict) -> Block:
    return Block(np.frombuffer(row["hashes"], "<u8"), unpacked(row["word"], "<u4").astype(np.int64), unpacked(row["lengths"], "<i8"), unpacked(row["target"], "?"))


def held_by(bits: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    return sieve.passes(bits, batch.column(batch.schema.get_field_index(KEY)).to_pylist())


def marked_blocks(docs: DataFrame, target_ids: DataFrame, text_col: str) -> DataFrame:
    """Blocks of all rows, with the target rows marked.

    Rows whose id may be wanted by a filter of fixed size move to a join that
    decides; all others stay where they are read. The ids grow with the
    corpus, so they are never broadcast.
    """
    key = lambda name: F.unhex(F.md5(F.coalesce(F.col(name).cast("string"), F.lit(""))))
    wanted = materialise(target_ids.select(F.col("doc_id").alias("_id")).distinct(), "target-ids")
    bits = docs.sparkSession.sparkContext.broadcast(sieve.made(wanted.select(key("_id")), wanted.count()))
    keyed = docs.withColumn(KEY, key("doc_id"))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(held_by(bits.value, batch)))

    likely = keyed.mapInArrow(hits, keyed.schema).join(wanted.hint("merge"), F.col("doc_id") == F.col("_id"), "left")
    likely = likely.withColumn(TARGET, F.col("_id").isNotNull()).drop("_id")
    rest = keyed.withColumn(TARGET, F.lit(False))
    return written_blocks(likely, text_col, "likely").union(written_blocks(rest, text_col, "rest", bits))


def answers(blocks: DataFrame, ranges: int) -> DataFrame:
    """``kind, part, block, counts, distinct``: sums over all blocks of the grams that the block sent of this range.

    Kind 0 are words, 1 bigrams. A range of hashes is one group, of bounded
    mean size as ranges follow the corpus; a gram that all blocks hold adds 24
    bytes a block to one group.
    """
    schema = "kind int, part int, block string, counts binary, distinct long"

    borders = [((i << 64) + ranges - 1) // ranges for i in range(ranges)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = np.array(borders, np.uint64)
        for row in (r for b in batches for r in b.to_pylist()):
            block = read_block(row)
            pairs, number = block.bigrams()
            for kind, (hashes, of) in enumerate(((block.hashes, block.word), (pairs, number))):
                counts = block.counts(of, len(hashes)).astype("<i8")
                cuts = np.append(np.searchsorted(hashes, firsts), len(hashes)).tolist()
                out = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
                yield pa.RecordBatch.from_pydict({
                    "kind": pa.array([kind] * len(out), pa.int32()), "part": pa.array([i for i, _, _ in out], pa.int32()), "block": pa.array([row["block"]] * len(out), pa.string()),
                    "keys": pa.array([coded(hashes[a:b], firsts[i]) for i, a, b in out], pa.binary()), "sums": pa.array([packed(counts[a:b]) for _, a, b in out], pa.binary()),
                })

    def sum_range(group: pa.Table) -> pa.Table:
        base = np.uint64(borders[group.column("part")[0].as_py()])
        keys = [decoded(x, base) for x in group.column("keys").to_pylist()]
        own = [unpacked(x, "<i8", 2) for x in group.column("sums").to_pylist()]
        total, sums = summed(np.concatenate(keys), np.concatenate(own))
        found = [packed(sums[np.searchsorted(total, k)]) for k in keys]
        return pa.table({
            "kind": group.column("kind"), "part": group.column("part"), "block": group.column("block"),
            "counts": pa.array(found, pa.binary()), "distinct": pa.array([len(total)] + [0] * (len(found) - 1), pa.int64()),
        })

    sent = blocks.select("block", "hashes", "word", "lengths", "target").mapInArrow(send, "kind int, part int, block string, keys binary, sums binary")
    return materialise(sent.groupBy("kind", "part").applyInArrow(sum_range, schema), "lm-counts")


def losses(count: np.ndarray, context: np.ndarray, joint: np.ndarray, total: np.ndarray, vocabulary: int) -> np.ndarray:
    """Minus the logarithm of each word's probability.

    ``count``, ``context``, ``joint``: how often the model has the word, the
    word before it, and the two in a row; ``total``: words of the model.
    """
    single = (count + 1.0 / vocabulary) / (total + 1.0)
    share = np.where(context > 0, BIGRAM_WEIGHT, 0.0)
    return -np.log(share * (joint / np.maximum(context, 1)) + (1 - share) * single)


def own_counts(rows: np.ndarray, number: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (row, gram) keys and how often each row has the gram."""
    return np.unique(rows * size + number, return_counts=True)


def block_figures(block: Block, words: np.ndarray, pairs: np.ndarray, totals: tuple[int, int], vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean losses (background, target) of each row, by the counts of all other rows of the corpus.

    ``words`` and ``pairs`` have the corpus' counts of the block's words and
    bigrams, in two columns: all rows, target rows.
    """
    _, number = block.bigrams()
    size = max(1, len(block.hashes))
    rows, word, before = block.rows, block.word, np.maximum(block.before, 0)
    key, times = own_counts(rows, word, size)

    def mine(of: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(key, rows * size + of), max(0, len(key) - 1))
        return np.where(key[at] == rows * size + of, times[at], 0) if len(key) else np.zeros(0, np.int64)

    _, back, pair_times = np.unique(rows * max(1, len(pairs)) + number, return_inverse=True, return_counts=True)
    own_word, own_before, own_pair = mine(word), mine(before), pair_times[back]
    has = block.before >= 0
    sums = np.zeros((2, len(block.lengths)))
    for i in range(2):
        left = np.ones(len(rows), np.int64) if i == 0 else block.target[rows].astype(np.int64)  # whether the model has counted the row
        count = words[word, i] - left * own_word
        context = np.where(has, words[before, i] - left * own_before, 0)
        joint = pairs[number, i] - left * own_pair
        total = totals[i] - left * block.lengths[rows]
        sums[i] = np.bincount(rows, losses(count, context, joint, total, vocabulary), len(block.lengths))
    return sums / np.maximum(block.lengths, 1), block.lengths


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_words, target_loss, background_loss, difference`` to each row of ``docs`` (``doc_id``, the text, other columns), without its text.

    Losses are nats for each word; a lower difference is more like the target,
    which are the rows whose ids are in ``target_ids`` (``doc_id``). All rows
    make the background, and each is scored by the counts of all others: a
    text that occurs twice is known from its copy. Null and empty texts have no
    words and losses of 0; null ids are no target; repeated ids of
    ``target_ids`` count once, repeated rows of ``docs`` are rows of their own;
    texts of any length count whole; an empty table gives an empty result; with
    an empty target, its model knows only the vocabulary's size. Input columns
    that clash with output names get the suffix ``_in``.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = own_columns(docs, ["n_words", "target_loss", "background_loss", "difference", TARGET, KEY, "_id"])
    kept = [f for f in docs.schema.fields if f.name != text_col]
    blocks = marked_blocks(docs, target_ids, text_col)
    n_words, n_target = blocks.agg(F.sum("n_words"), F.sum("n_target")).first()
    ranges = max(MIN_RANGES, -(-(n_words or 0) // RANGE_GRAMS))
    found = answers(blocks, ranges)
    vocabulary = found.where("kind = 0").agg(F.sum("distinct")).first()[0] or 1
    totals = (n_words or 0, n_target or 0)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), FIGURES])

    def score(own: pa.Table, sent: pa.Table) -> pa.Table:
        row = own.slice(0, 1).to_pylist()[0]
        counts: list[dict[int, bytes]] = [{}, {}]
        for kind, part, data in zip(*(sent.column(n).to_pylist() for n in ("kind", "part", "counts")), strict=True):
            counts[kind][part] = data
        words, pairs = (np.concatenate([unpacked(x[p], "<i8", 2) for p in sorted(x)] or [np.zeros((0, 2), np.int64)]) for x in counts)
        mean, n = block_figures(read_block(row), words, pairs, totals, vocabulary)
        rows = pa.ipc.open_stream(row["rows"]).read_all()
        figures = {"n_words": n, "target_loss": mean[1], "background_loss": mean[0], "difference": mean[1] - mean[0]}
        return pa.table({x: rows.column(x) for x in rows.column_names} | {x: pa.array(v) for x, v in figures.items()})

    slim = blocks.select("block", "rows", "hashes", "word", "lengths", "target")
    return slim.groupBy("block").cogroup(found.select("block", "kind", "part", "counts").groupBy("block")).applyInArrow(score, schema)
