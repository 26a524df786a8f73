"""Byte-level BPE with reuse of content-defined chunks.

A rolling hash cuts texts at places that depend on the last 32 bytes only, so
documents that share a passage share its chunks. Each worker encodes a chunk
once and keeps its ids in a bounded cache. Cuts may fall inside words, so each
join is repaired: the text around it is encoded again from a boundary that is
certain in the left chunk until its boundaries agree with the right chunk's.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleanwork.llm._shared import bound_batches, byte_values, own_columns, pieces
from gleanwork.llm.words import BYTE_VALUES, mixed, powers

CUT_BITS = 10
MIN_CHUNK = 160
MAX_CACHED_BYTES = 24 << 20
MAX_CACHED_WORDS = 800_000
#: Bytes of context after which no lookahead or contraction of the split pattern can change a boundary.
CERTAIN = 16
#: Bytes of the right chunk that a repair looks at.
AHEAD = 96
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
#: Endings that stay with their apostrophe.
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def gear_table(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


GEAR = gear_table()


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 bytes that end at each place, by doubling the window five times."""
    h = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        out = h.copy()
        out[width:] += h[:-width] << np.uint32(width)
        h = out
    return h


def cut_places(texts: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each text, its end last; never inside a character."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    out: list[list[int]] = [[] for _ in texts]
    if len(raw) > 32:
        # the hash at i covers the bytes before i + 1
        hits = np.flatnonzero((rolling_hash(raw) >> np.uint32(32 - CUT_BITS)) == 0) + 1
        hits = hits[hits < len(raw)]
        hits = hits[(raw[hits] & 0xC0) != 0x80]
        own = np.searchsorted(ends, hits, side="right")
        inside = hits - (ends - sizes)[own]
        fit = (inside >= MIN_CHUNK) & (sizes[own] - inside >= MIN_CHUNK)
        for i, p in zip(own[fit].tolist(), inside[fit].tolist(), strict=True):
            cuts = out[i]
            if not cuts or p - cuts[-1] >= MIN_CHUNK:
                cuts.append(p)
    for cuts, n in zip(out, sizes.tolist(), strict=True):
        cuts.append(n)
    return out


class CharacterClasses:
    """Class of each code point in the byte-level split pattern, asked of the library when it is first met."""

    def __init__(self) -> None:
        from tokenizers import pre_tokenizers

        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.table = np.full(0x110000, UNKNOWN, np.uint8)
        self.learn(np.arange(0x240))
        #: By byte, for characters of one byte.
        self.single = np.concatenate([self.table[:128], np.full(128, OTHER, np.uint8)])

    def kind(self, char: str) -> int:
        """The class whose run goes on through the character."""
        together = lambda x: len(self.split(x + char + x)) == 1
        return LETTER if together("a") else NUMBER if together("1") else OTHER if together("!") else SPACE

    def learn(self, codes: np.ndarray) -> None:
        self.table[codes] = [self.kind(chr(c)) for c in codes.tolist()]

    def of(self, codes: np.ndarray) -> np.ndarray:
        found = self.table[codes]
        if (found == UNKNOWN).any():
            self.learn(np.unique(codes[found == UNKNOWN]))
            found = self.table[codes]
        return found


@cache
def character_classes() -> CharacterClasses:
    return CharacterClasses()


def byte_classes(raw: np.ndarray) -> np.ndarray:
    """Class of the character of each byte of valid UTF-8."""
    classes = character_classes()
    kind = classes.single[raw]
    leads = np.flatnonzero(raw >= 0xC0)
    for least, most, size in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0x100, 4)) if len(leads) else ():
        lead = leads[(raw[leads] >= least) & (raw[leads] < most)]
        if len(lead):
            code = raw[lead].astype(np.int64) & (0xFF >> (size + 1))
            for i in range(1, size):
                code = (code << 6) | (raw[lead + i] & 0x3F)
            found = classes.of(code)
            for i in range(size):
                kind[lead + i] = found
    return kind


def pretoken_starts(raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether a pre-token of the byte-level split pattern begins at each byte.

    ``raw`` is valid UTF-8 and ``begin`` has the first byte of each text in
    it. Runs of letters, of digits and of other signs are pre-tokens, each
    with one plain space in front; of longer white space before a run the last
    sign is left over.
    """
    n = len(raw)
    kind = byte_classes(raw)
    first = np.zeros(n + 1, bool)
    first[begin] = True
    first[n] = True
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    start |= first
    runs = np.flatnonzero(start)
    at, end = runs[:-1], runs[1:]
    # white space before something else in its text
    s = (kind[at] == SPACE) & ~first[end]
    e = end[s]
    last = e - 1
    for _ in range(3):  # to the first byte of its last character
        last = last - ((raw[last] & 0xC0) == 0x80)
    start[last] = True
    start[e[raw[e - 1] == 0x20]] = False
    # a lone apostrophe with one of the endings after it
    q = np.flatnonzero((raw[at] == 0x27) & (end - at == 1) & (kind[at] == OTHER) & ~first[end])
    q = q[start[at[q]]]
    for i in q.tolist():
        p, upto = int(at[i]) + 1, int(end[i + 1])
        word = raw[p : min(p + 2, upto)].tobytes()
        size = next((len(x) for x in ENDINGS if word.startswith(x)), 0)
        if size:
            start[p] = False
            if p + size < upto:
                start[p + size] = True
    return start[:n]


def byte_of_char() -> dict[str, int]:
    """Bytes behind the printable characters in which byte-level vocabularies are written."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places ``start[i], ..., start[i] + length[i] - 1`` of all i, one after the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def alike(raw: np.ndarray, at: np.ndarray, size: np.ndarray, where: np.ndarray, back: np.ndarray) -> bool:
    """Whether each word ``raw[at:at + size]`` has the bytes of word ``where[back]``: the first eight at once, more one by one."""
    if (size != size[where][back]).any():
        return False
    padded = np.append(raw, np.zeros(8, np.uint8))
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))[at]
    eight &= (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(size, 8).astype(np.uint64)))
    if (eight != eight[where][back]).any():
        return False
    long = np.flatnonzero(size > 8)
    return bool((raw[spread(at[long] + 8, size[long] - 8)] == raw[spread(at[where][back[long]] + 8, size[long] - 8)]).all())


class Words:
    """Ids of pre-tokens, found by a 64-bit hash and held against their bytes; the library's model encodes what is not known.

    Beyond the bound only the words of the latest call are kept.
    """

    def __init__(self, model, letters: dict[int, str]) -> None:  # noqa: ANN001
        self.model, self.letters = model, letters
        none = np.zeros(0, np.int64)
        #: Sorted hashes and the row of each; rows are in the order in which words came.
        self.keys, self.rows = np.zeros(0, np.uint64), none
        self.start, self.length, self.flat = none, none, np.zeros(0, np.uint32)
        self.from_, self.size, self.bytes = none, none, np.zeros(0, np.uint8)
        self.exact = 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place among the hashes, whether there, and row (if there) of each."""
        at = np.searchsorted(self.keys, keys)
        if not len(self.keys):
            return at, np.zeros(len(keys), bool), at
        inside = np.minimum(at, len(self.keys) - 1)
        return at, self.keys[inside] == keys, self.rows[inside]

    def made(self, words: list[bytes]) -> list[list[int]]:
        tokenize, letters = self.model.tokenize, self.letters
        return [[t.id for t in tokenize(w.decode("latin-1").translate(letters))] for w in words]

    def learn(self, keys: np.ndarray, at: np.ndarray, words: list[bytes]) -> None:
        """Add sorted hashes that belong at the places ``at``."""
        made = self.made(words)
        length = np.fromiter(map(len, made), np.int64, len(made))
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.keys = np.insert(self.keys, at, keys)
        self.rows = np.insert(self.rows, at, len(self.length) + np.arange(len(keys)))
        self.start = np.append(self.start, len(self.flat) + np.cumsum(length) - length)
        self.from_ = np.append(self.from_, len(self.bytes) + np.cumsum(size) - size)
        self.length, self.size = np.append(self.length, length), np.append(self.size, size)
        self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(made), np.uint32, int(length.sum())))
        self.bytes = np.append(self.bytes, np.frombuffer(b"".join(words), np.uint8))

    def look_up(self, keys: np.ndarray, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Places and numbers of ids in ``flat`` of sorted distinct hashes, whose words are ``raw[begin:end]``; none if another word has one of the hashes."""
        at, hit, row = self.find(keys)
        if not hit.all():
            miss = np.flatnonzero(~hit)
            whole = raw.tobytes()
            self.learn(keys[miss], at[miss], [whole[a:b] for a, b in zip(begin[miss].tolist(), end[miss].tolist(), strict=True)])
            _, _, row = self.find(keys)
        size = end - begin
        if (self.size[row] != size).any() or (self.bytes[spread(self.from_[row], size)] != raw[spread(begin, size)]).any():
            return None
        start, length = self.start[row], self.length[row]
        if len(self.keys) > MAX_CACHED_WORDS:
            self.flat, self.bytes = self.flat[spread(start, length)], self.bytes[spread(self.from_[row], size)]
            self.keys, self.rows, self.length, self.size = keys, np.arange(len(keys)), length, size
            self.start, self.from_ = np.cumsum(length) - length, np.cumsum(size) - size
            start = self.start
        return start, length

    def ids(self, raw: np.ndarray, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens that begin at ``at`` in ``raw`` and fill it, and how many each has.

        Equal pre-tokens are looked up once. Where two words have one hash,
        the pre-tokens of the call are told apart by their bytes alone.
        """
        upto = np.append(at[1:], len(raw))
        keys, where, back = np.unique(keys, return_index=True, return_inverse=True)
        found = self.look_up(keys, raw, at[where], upto[where]) if alike(raw, at, upto - at, where, back) else None
        if found is None:
            self.exact += 1
            whole = raw.tobytes()
            number: dict[bytes, int] = {}
            back = np.array([number.setdefault(whole[a:b], len(number)) for a, b in zip(at.tolist(), upto.tolist(), strict=True)])
            made = self.made(list(number))
            length = np.fromiter(map(len, made), np.int64, len(made))
            start, flat = np.cumsum(length) - length, np.fromiter(chain.from_iterable(made), np.uint32, int(length.sum()))
        else:
            (start, length), flat = found, self.flat
        counts = length[back]
        return flat[spread(start[back], counts)], counts


class Chunk:
    """Ids of a chunk, its first boundaries (byte, token), and the last one that its end cannot change."""

    __slots__ = ("back", "head", "ids", "size")

    def __init__(self, ids: np.ndarray, at: np.ndarray, token: np.ndarray, size: int) -> None:
        self.ids, self.size = ids, size
        n = int(np.searchsorted(at, AHEAD, side="right"))
        self.head = list(zip(at[:n].tolist(), token[:n].tolist(), strict=True))
        last = int(np.searchsorted(at, size - CERTAIN, side="right")) - 1
        self.back = (int(at[last]), int(token[last])) if last >= 0 else None


def valid(data: bytes) -> bytes:
    try:
        data.decode()
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace").encode()
    return data


Encoded = tuple[np.ndarray, np.ndarray, np.ndarray, int]


class Encoder:
    """Encodes and decodes as the tokenizers library does with the same file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        added = spec["added_tokens"]
        #: Only for this common form; any other file is encoded by the library alone.
        self.simple = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
            and len(added) <= 1 and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        )
        self.special = added[0] if added else None
        #: Chunks of late and those before them; what is used again moves to the former.
        self.chunks: dict[bytes, Chunk] = {}
        self.older: dict[bytes, Chunk] = {}
        self.cached = 0
        self.reused = self.encoded = self.repaired = 0
        back = byte_of_char()
        self.words = Words(self.tokenizer.model, {b: c for c, b in back.items()})
        size = max([self.tokenizer.get_vocab_size() - 1, *(t["id"] for t in added)]) + 1
        names = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.raw = [b"" if n is None else bytes(back[c] for c in n) if all(c in back for c in n) else n.encode() for n in names]
        self.decimal = [str(i) for i in range(size)]

    def plain(self, texts: list[bytes]) -> list[Encoded]:
        """Ids, pre-tokens' places and first tokens, and size of each text, encoded whole."""
        sizes = np.array([len(t) for t in texts])
        whole = b"".join(texts)
        if not whole:
            none = np.zeros(0, np.int64)
            return [(none.astype(np.uint32), none, none, 0) for _ in texts]
        raw = np.frombuffer(whole, np.uint8)
        ends = np.cumsum(sizes)
        begin = ends - sizes
        at = np.flatnonzero(pretoken_starts(raw, begin[sizes > 0]))
        upto = np.append(at[1:], len(raw))
        up, down = powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[raw] * up[: len(raw)], out=total[1:])
        ids, counts = self.words.ids(raw, at, mixed((total[upto] - total[at]) * down[at]))
        token = np.cumsum(counts) - counts
        cut = np.searchsorted(at, np.append(begin, len(raw)))
        tokens = np.append(token, len(ids))
        out = []
        for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            t = int(tokens[a])
            out.append((ids[t : int(tokens[b])].copy(), at[a:b] - begin[i], tokens[a:b] - t, int(sizes[i])))
        return out

    def chunked(self, pieces: list[bytes]) -> list[Chunk]:
        """Chunks by their bytes; each is encoded once as long as the cache holds it."""
        if self.cached > MAX_CACHED_BYTES // 2:
            self.older, self.chunks, self.cached = self.chunks, {}, 0
        fresh = []
        for p in dict.fromkeys(pieces):
            if p not in self.chunks:
                if (c := self.older.get(p)) is None:
                    fresh.append(p)
                else:
                    self.keep(p, c)
        self.encoded += len(fresh)
        self.reused += len(pieces) - len(fresh)
        for p, c in zip(fresh, self.plain(fresh), strict=True):
            self.keep(p, Chunk(*c))
        return [self.chunks[p] for p in pieces]

    def keep(self, piece: bytes, chunk: Chunk) -> None:
        self.chunks[piece] = chunk
        self.cached += 3000 + 3 * len(piece)

    def joined(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts from their chunks.

        A left chunk's boundaries are certain up to 16 bytes before its end.
        From the last of them the text is split again, past the join; where
        that split and the right chunk's share a boundary with 16 more bytes
        in sight, both go on alike. A text with a join that finds no such
        place is encoded whole.
        """
        cuts = cut_places(texts)
        spans = [(i, a, b) for i, c in enumerate(cuts) for a, b in zip([0, *c], c, strict=False)]
        found = self.chunked([texts[i][a:b] for i, a, b in spans])
        chunks: list[list[Chunk]] = [[] for _ in texts]
        for (i, _, _), c in zip(spans, found, strict=True):
            chunks[i].append(c)
        joins, windows = [], []
        for i, row in enumerate(chunks):
            place = 0
            for j in range(len(row) - 1):
                left, right = row[j], row[j + 1]
                place += left.size
                back, ahead = left.back, right.head
                if back is not None and (back[0] or not j) and ahead[-1][0] > CERTAIN:
                    joins.append((i, j, back, ahead, left.size - back[0]))
                    windows.append(texts[i][place - left.size + back[0] : place + ahead[-1][0]])
                else:
                    joins.append((i, j, None, None, 0))
                    windows.append(b"")
        self.repaired += len(joins)
        stays: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in texts]  # of each join: tokens kept left, tokens replaced right, ids between
        whole: dict[int, None] = {}
        for (i, _, back, ahead, offset), w in zip(joins, self.plain(windows), strict=True):
            place = None
            if back is not None:
                known = dict(ahead)
                last = ahead[-1][0] - CERTAIN
                place = next(((known[a - offset], t) for a, t in zip(w[1].tolist(), w[2].tolist(), strict=True) if a - offset >= 0 and a - offset <= last and a - offset in known), None)
            if place is None or (stays[i] and back[1] < stays[i][-1][1]):
                whole[i] = None
            else:
                stays[i].append((back[1], place[0], w[0][: place[1]]))
        out: list[np.ndarray] = []
        for i, row in enumerate(chunks):
            parts, skip = [], 0
            if i not in whole:
                for c, (keep, replaced, between) in zip(row, stays[i], strict=False):
                    parts += [c.ids[skip:keep], between]
                    skip = replaced
                parts.append(row[-1].ids[skip:])
            out.append(np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.uint32))
        if whole:
            for i, c in zip(whole, self.plain([texts[i] for i in whole]), strict=True):
                out[i] = c[0]
        return out

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text in UTF-8, as uint32; bytes that are not UTF-8 count as replacement characters."""
        mark = self.special["content"].encode() if self.special else b""
        out: list[np.ndarray | None] = [None] * len(texts)
        parts: list[bytes] = []
        owner: list[tuple[int, int]] = []
        for i, data in enumerate(texts):
            if not data:
                out[i] = np.zeros(0, np.uint32)
            elif not self.simple:
                out[i] = np.array(self.tokenizer.encode(data.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
            else:
                data = valid(data)
                own = data.split(mark) if mark and mark in data else [data]
                owner.append((i, len(own)))
                parts += own
        done = iter(self.joined(parts)) if parts else iter(())
        for i, n in owner:
            row = [next(done) for _ in range(n)]
            if n > 1:
                between = np.array([self.special["id"]], np.uint32)
                row = [x for k, y in enumerate(row) for x in ((between, y) if k else (y,))]
            out[i] = np.concatenate(row) if len(row) > 1 else row[0]
        return out

    def encode(self, data: bytes) -> list[int]:
        return self.encode_all([data])[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        """Decoded text in UTF-8; bytes that are not UTF-8 become replacement characters."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw.decode("utf-8", "replace").encode()


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process, so that its caches outlive a task."""
    return Encoder(path)


OUTPUT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", ids_col: str | None = None) -> DataFrame:
    """Add ``n_tokens, ids_sha256, decoded_sha256`` (and the ids, as ``ids_col``) of each row's whole text.

    One output row for each input row, no shuffle; repeated rows are rows of
    their own and an empty table gives an empty result. Null counts as empty and
    has no tokens; texts of any length and any characters are encoded in chunks;
    input columns that clash with output names get the suffix
    ``_in``. ``path`` names a byte-level BPE file of the tokenizers library
    that all executors have.
    """
    bound_batches(docs.sparkSession)
    docs = own_columns(docs, ["n_tokens", "ids_sha256", "decoded_sha256", *([ids_col] if ids_col else [])])
    kept = [f for f in docs.schema.fields if f.name != text_col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), OUTPUT, *([f"`{ids_col}` array<int>"] if ids_col else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        decimal = own.decimal
        for batch in (x for b in batches for x in pieces(b, text_col, 900_000)):
            at = batch.schema.get_field_index(text_col)
            counts, ids_sha, text_sha, all_ids = [], [], [], []
            for ids in map(np.ndarray.tolist, own.encode_all(byte_values(batch.column(at)))):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if ids_col:
                    all_ids.append(ids)
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if i != at}
            columns |= {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            if ids_col:
                columns[ids_col] = pa.array(all_ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, schema)
