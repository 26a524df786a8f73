"""Alignment of two tokenizers' tokens over the bytes of each text.

The ends of both tokenizers' tokens cut a text into elementary intervals
(``union1d``). Each lies in one token of either side (``searchsorted``), so
each interval is one overlap: a link. An end that both share closes a group.

Texts are read once. A task aligns its texts, keeps the distinct links of some
megabytes of text as a block, and writes for each text the places of its links
in its block. The blocks' link counts are summed over the corpus in the JVM and
dealt back to the blocks, where each text's sums are looked up. So what moves
is a row for each block and distinct link, never one for each link.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.llm._shared import bound_batches, byte_values, materialise, own_columns, pieces
from gleanwork.llm.bpe import Encoder, Words, encoder, valid
from gleanwork.llm.words import BYTE_VALUES, mixed, powers

#: Bytes of text that are aligned at once, and distinct links of texts after which a block ends.
SLICE = 1 << 20
BLOCK_LINKS = 2_000_000
#: A space between two signs: both tokenizers begin a token there.
SAFE = re.compile(r"(?<=\S) (?=\S)")
MARK = "▁"
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_products"]
OUTPUT = [*COUNTS, "n_best", "count_sum", "groups_sha256"]


class Pieces(Words):
    """Ids of the segments (spaces and what follows up to the next space) of a piece model, each encoded once.

    No piece of the model goes on from a sign to a space, so segments are encoded alone.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_file=path)
        super().__init__(None, {})
        n = self.processor.get_piece_size()
        names = [self.processor.id_to_piece(i) for i in range(n)]
        if any(MARK in x.lstrip(MARK) for x in names) or MARK not in names or self.processor.decode(self.processor.encode(" a  b ")) != " a  b ":
            raise ValueError(f"{path} is no piece model that keeps all spaces and begins pieces at them")
        self.raw = [bytes([int(x[3:5], 16)]) if self.processor.is_byte(i) else x.replace(MARK, " ").encode() for i, x in enumerate(names)]
        #: Stands for a segment whose pieces are not its bytes.
        self.bad = n
        self.sizes = np.array([*map(len, self.raw), 0])
        self.space = names.index(MARK)

    def made(self, words: list[bytes]) -> list[list[int]]:
        # the model puts a space of its own in front, and gives nothing for no text
        found = self.processor.encode([w[1:].decode() for w in words], num_threads=1)
        found = [[self.space] if w == b" " else x for w, x in zip(words, found, strict=True)]
        return [x if b"".join(map(self.raw.__getitem__, x)) == w else [self.bad] for w, x in zip(words, found, strict=True)]

    def encode_all(self, raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Ids of joined texts, each of which begins with a space at its place in ``begin``."""
        space = raw == 0x20
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[begin] = True
        at = np.flatnonzero(first)
        upto = np.append(at[1:], len(raw))
        up, down = powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[raw] * up[: len(raw)], out=total[1:])
        ids, _ = self.ids(raw, at, mixed((total[upto] - total[at]) * down[at]))
        return ids.astype(np.int64)


def elementary_intervals(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the elementary intervals, and the token of either side that holds each."""
    ends = np.union1d(end_a, end_b)
    return ends, np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)


def slices(data: bytes, most: int | None = None) -> Iterator[bytes]:
    """A space and the text, in pieces that begin with a space; longer than ``most`` only where no such place is in sight."""
    most = most or SLICE
    if len(data) < most:
        yield b" " + data
        return
    text, at = " " + data.decode(), 0
    while at < len(text):
        found = SAFE.search(text, at + most // 2)
        upto = found.start() if found else len(text)
        yield text[at:upto].encode()
        at = upto


class Aligned(NamedTuple):
    """What the alignment of a slice gives."""

    #: As in ``COUNTS``.
    counts: np.ndarray
    #: Codes of the links in order.
    links: np.ndarray
    #: Groups as text, an end mark after each.
    groups: str


class Aligner:
    def __init__(self, a_path: str, b_path: str) -> None:
        self.a: Encoder = encoder(a_path)
        if not self.a.simple:
            raise ValueError(f"{a_path} is no plain byte-level vocabulary")
        self.b = Pieces(b_path)
        self.a_sizes = np.array([*map(len, self.a.raw)])
        self.b_count = len(self.b.raw)
        #: Ids as text with what follows them: A within and at the end of a group, then B.
        self.b_base = 2 * len(self.a.raw)
        self.names = [f"{i}{end}" for n, end in ((len(self.a.raw), ","), (len(self.a.raw), "|"), (self.b_count, ","), (self.b_count, ";")) for i in range(n)]

    def align(self, parts: list[bytes]) -> list[Aligned | None]:
        """Each slice aligned; none where the tokens' bytes are not the slice."""
        if not parts:
            return []
        size = np.array([len(p) for p in parts])
        upto = np.cumsum(size)
        raw = np.frombuffer(b"".join(parts), np.uint8)
        own = self.a.joined(parts)
        a_ids = np.concatenate(own).astype(np.int64)
        b_ids = self.b.encode_all(raw, upto - size)
        a_whole = np.array([int(self.a_sizes[x].sum()) for x in own]) == size
        if not a_whole.all() or (b_ids == self.b.bad).any():
            good = [i for i, p in enumerate(parts) if a_whole[i] and not (self.b.encode_all(np.frombuffer(p, np.uint8), np.zeros(1, np.int64)) == self.b.bad).any()]
            out: list[Aligned | None] = [None] * len(parts)
            for i, x in zip(good, self.align([parts[i] for i in good]), strict=True):
                out[i] = x
            return out
        end_a, end_b = np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b.sizes[b_ids])
        ends, a, b = elementary_intervals(end_a, end_b)
        links = a_ids[a] * self.b_count + b_ids[b]
        shared = ends[(end_a[a] == ends) & (end_b[b] == ends)]
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        products = np.append(0, np.cumsum(np.bincount(group_a) * np.bincount(group_b)))
        # texts of the groups: a group's tokens of the first side, then those of the second
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        words = np.empty(len(a_ids) + len(b_ids), np.int64)
        words[np.arange(len(a_ids)) + np.searchsorted(group_b, group_a)] = a_ids + last_a * len(self.a.raw)
        words[np.arange(len(b_ids)) + np.searchsorted(group_a, group_b, side="right")] = self.b_base + b_ids + last_b * self.b_count
        cut_a, cut_b, cut_links, cut_groups = (np.append(0, np.searchsorted(x, upto, side="right")) for x in (end_a, end_b, ends, shared))
        text = list(map(self.names.__getitem__, words.tolist()))
        cut_words = (cut_a + cut_b).tolist()
        counts = np.stack([np.diff(cut_a), np.diff(cut_b), np.diff(cut_groups), np.diff(cut_links), np.diff(products[cut_groups])], axis=1)
        return [Aligned(counts[i], links[cut_links[i] : cut_links[i + 1]], "".join(text[cut_words[i] : cut_words[i + 1]])) for i in range(len(parts))]

    def documents(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[np.ndarray], str]]:
        """Counts, codes of links (in parts) and the groups' digest of each text; zeros and ``''`` for a text without tokens."""
        parts: list[bytes] = []
        size = 0

        def flush() -> Iterator[tuple[np.ndarray, list[np.ndarray], str]]:
            for x in self.align(parts):
                yield (x.counts, [x.links], hashlib.sha256(x.groups[:-1].encode()).hexdigest()) if x else NOTHING

        for data in texts:
            data = valid(data)
            if data and len(data) < SLICE // 2:
                parts.append(b" " + data)
                size += len(data)
                if size >= SLICE:
                    yield from flush()
                    parts, size = [], 0
                continue
            yield from flush()
            parts, size = [], 0
            yield self.long(data) if data else NOTHING
        yield from flush()

    def long(self, data: bytes) -> tuple[np.ndarray, list[np.ndarray], str]:
        """A text slice by slice."""
        counts, links, text = np.zeros(len(COUNTS), np.int64), [], hashlib.sha256()
        end = ""
        for part in slices(data):
            found = self.align([part])[0]
            if found is None:
                return NOTHING
            counts = counts + found.counts
            links.append(found.links)
            text.update((end + found.groups[:-1]).encode())
            end = ";"
        return counts, links, text.hexdigest()


NOTHING = (np.zeros(len(COUNTS), np.int64), [], "")


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process, so that its caches outlive a task."""
    return Aligner(a_path, b_path)


def planes(values: np.ndarray) -> bytes:
    """Numbers below 2**32 by byte planes, as many as the largest needs."""
    k = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([k]) + values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :k].T.tobytes()


def from_planes(data: memoryview, n: int) -> tuple[np.ndarray, int]:
    """Numbers of ``planes`` and the bytes they took."""
    k = data[0]
    own = np.zeros((n, 4), np.uint8)
    own[:, :k] = np.frombuffer(data[1 : 1 + k * n], np.uint8).reshape(k, n).T
    return own.view("<u4").ravel().astype(np.int64), 1 + k * n


def packed(places: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending places in a block's links and how often each occurs."""
    return len(places).to_bytes(4, "little") + planes(np.diff(places, prepend=0)) + planes(times)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    view = memoryview(data)[4:]
    steps, used = from_planes(view, n)
    return np.cumsum(steps), from_planes(view[used:], n)[0]


class Block:
    """Texts whose links are written against one list of distinct links."""

    def __init__(self) -> None:
        self.rows: list[tuple[np.ndarray, str]] = []
        self.owners: list[np.ndarray] = []
        self.codes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.batches: list[pa.RecordBatch] = []
        self.links = 0

    def add(self, counts: np.ndarray, links: list[np.ndarray], digest: str) -> None:
        if links:
            codes, times = np.unique(np.concatenate(links) if len(links) > 1 else links[0], return_counts=True)
            self.owners.append(np.full(len(codes), len(self.rows)))
            self.codes.append(codes)
            self.times.append(times)
            self.links += len(codes)
        self.rows.append((counts, digest))

    def entries(self) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
        """Distinct links, how often each occurs, and each text's packed entries."""
        if not self.codes:
            none = np.zeros(0, np.int64)
            return none, none, [None] * len(self.rows)
        codes, times, owners = map(np.concatenate, (self.codes, self.times, self.owners))
        distinct, places = np.unique(codes, return_inverse=True)
        total = np.bincount(places, times).astype(np.int64)
        cut = np.searchsorted(owners, np.arange(len(self.rows) + 1))
        return distinct, total, [packed(places[i:j], times[i:j]) if j > i else None for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, text_col: str) -> DataFrame:
    """Two kinds of rows: texts with counts and packed entries, and (``pairs`` not null) the distinct links of each block.

    A block's link is a long: the pair's code and below it 32 bits of its count in the block.
    """
    kept = [f for f in docs.schema.fields if f.name != text_col]
    extra = pa.schema([("block_", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("groups_sha256", pa.string()), ("entries_", pa.binary()), ("pairs_", pa.list_(pa.int64()))])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "block_ long", *(f"{c} long" for c in COUNTS), "groups_sha256 string, entries_ binary, pairs_ array<long>"])

    block_links = BLOCK_LINKS

    def written(block: Block, number: int) -> Iterator[pa.RecordBatch]:
        distinct, total, entries = block.entries()
        counts = np.array([c for c, _ in block.rows]).reshape(-1, len(COUNTS))
        first = 0
        for batch in block.batches:
            n = batch.num_rows
            own = {c: pa.array(counts[first : first + n, i], pa.int64()) for i, c in enumerate(COUNTS)}
            own |= {"block_": pa.array([number] * n, pa.int64()), "groups_sha256": pa.array([d for _, d in block.rows[first : first + n]], pa.string())}
            own |= {"entries_": pa.array(entries[first : first + n], pa.binary()), "pairs_": pa.nulls(n, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([*batch.columns, *(own[c] for c in extra.names)], names=[*batch.schema.names, *extra.names])
            first += n
        if len(distinct):
            one = [pa.nulls(1, f.type) for f in block.batches[0].schema]
            own = {f.name: pa.nulls(1, f.type) for f in extra} | {"block_": pa.array([number], pa.int64()), "pairs_": pa.array([distinct << 32 | total], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([*one, *(own[c] for c in extra.names)], names=[*block.batches[0].schema.names, *extra.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = aligner(a_path, b_path), Block()
        number = TaskContext.get().partitionId() << 32
        for batch in (x for b in batches for x in pieces(b, text_col, SLICE)):
            at = batch.schema.get_field_index(text_col)
            for found in own.documents(byte_values(batch.column(at))):
                block.add(*found)
            block.batches.append(batch.drop_columns([text_col]))
            if block.links >= block_links:
                yield from written(block, number)
                block, number = Block(), number + 1
        if block.batches:
            yield from written(block, number)

    return docs.mapInArrow(run, schema)


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """Align the tokens of a byte-level vocabulary (A) and a piece model (B) over each whole text with a space in front.

    One row for each input row: its other columns and ``n_a, n_b`` (tokens),
    ``n_groups``, ``n_links`` (token pairs whose bytes overlap), ``n_products``
    (pairs of tokens of one group: products of the groups' sizes, counted and
    never listed), ``n_best`` (links whose pair is the corpus-wide most frequent
    of its B id, ties included), ``count_sum`` (corpus counts of the pairs of
    all links) and ``groups_sha256`` of the groups as text.

    Null and empty texts, and texts whose tokens' bytes are not the text with a
    space in front, have zeros and ``''`` and count nowhere. Special tokens'
    names are plain text; bytes that are not UTF-8 count as replacement
    characters. Texts of any length are aligned slice by slice. Repeated rows
    count each for itself; an empty table gives an empty result; input columns
    that clash with output names get the suffix ``_in``.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = own_columns(docs, [*OUTPUT, "block_", "entries_", "pairs_", "place_", "link_", "pair_", "value_", "to_"])
    kept = [f for f in docs.schema.fields if f.name != text_col]
    stage = materialise(aligned_blocks(docs, a_path, b_path, text_col), "aligned-blocks")
    b_count = piece_count(b_path)
    links = stage.where("pairs_ is not null").select("block_", F.posexplode("pairs_").alias("place_", "link_"))
    links = links.select("block_", "place_", F.shiftright("link_", 32).alias("pair_"), F.col("link_").bitwiseAND((1 << 32) - 1).alias("n_"))
    counts = links.groupBy("pair_").agg(F.sum("n_").alias("count_")).withColumn("b_", F.col("pair_") % b_count)
    # a row for each id of B: as many as the model has pieces, whatever the corpus
    top = counts.groupBy("b_").agg(F.max("count_").alias("top_"))
    marked = counts.join(F.broadcast(top), "b_").select("pair_", (F.col("count_") * 2 + (F.col("count_") == F.col("top_")).cast("int")).alias("value_"))
    replies = links.join(marked, "pair_").select(F.col("block_").alias("to_"), "place_", "value_")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in OUTPUT)])

    def looked_up(texts: pa.Table, found: pa.Table) -> pa.Table:
        value = np.zeros(len(found), np.int64)
        value[found["place_"].to_numpy()] = found["value_"].to_numpy()
        best, total = [], []
        for data in texts["entries_"].to_pylist():
            if data:
                places, times = unpacked(data)
                own = value[places]
                best.append(int((times * (own & 1)).sum()))
                total.append(int((times * (own >> 1)).sum()))
            else:
                best.append(0)
                total.append(0)
        columns = {n: texts[n] for n in texts.column_names if n not in ("block_", "entries_")}
        columns |= {"n_best": pa.array(best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
        return pa.table({n: columns[n] for n in [*(f.name for f in kept), *OUTPUT]})

    texts = stage.where("pairs_ is null").drop("pairs_")
    return texts.groupBy("block_").cogroup(replies.groupBy("to_")).applyInArrow(looked_up, schema)


@cache
def piece_count(path: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path).get_piece_size()


def token_groups(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """The groups themselves: the input's other columns, and of each group ``group_place``, ``a_ids`` and ``b_ids``.

    Texts without tokens have no rows. The pairs of a group are the product of its two arrays, those that overlap its ``links``.
    """
    bound_batches(docs.sparkSession)
    docs = own_columns(docs, ["groups_", "group_place", "a_ids", "b_ids"])
    kept = [f for f in docs.schema.fields if f.name != text_col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "groups_ string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in (x for b in batches for x in pieces(b, text_col, SLICE)):
            at = batch.schema.get_field_index(text_col)
            found = []
            for data in map(valid, byte_values(batch.column(at))):
                done = [own.align([part])[0] for part in slices(data)] if data else [None]
                found.append(None if None in done else "".join(x.groups for x in done)[:-1])
            rest = batch.drop_columns([text_col])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(found, pa.string())], names=[*rest.schema.names, "groups_"])

    rows = docs.mapInArrow(run, schema).where("groups_ is not null")
    rows = rows.select(*(F.col(f"`{f.name}`") for f in kept), F.posexplode(F.split("groups_", ";")).alias("group_place", "group_"))
    ids = lambda i: F.split(F.split("group_", r"\|")[i], ",").cast("array<int>")
    return rows.select(*(F.col(f"`{f.name}`") for f in kept), "group_place", ids(0).alias("a_ids"), ids(1).alias("b_ids"))
