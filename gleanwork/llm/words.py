"""Vectorised hashing of words and word runs in Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE_VALUES = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)
#: A second polynomial, over a prime field: modulo 2**64 alone, long words made by
#: doubling (the Thue-Morse word and its complement) have equal values at any base.
PRIME, PRIME_BASE = (1 << 31) - 1, 1_220_703_125
PRIME_INVERSE = pow(PRIME_BASE, -1, PRIME)
PRIME_VALUES = np.random.default_rng(8).integers(1, PRIME, 256, dtype=np.uint64)
RUN_FACTORS = np.random.default_rng(4).integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Longest table of powers that a worker keeps; longer texts make their own for the moment.
KEPT_POWERS = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i below n, modulo 2**64."""
    return kept_powers() if n <= KEPT_POWERS else made_powers(n)


@cache
def kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return made_powers(KEPT_POWERS)


def made_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up, out=up), np.multiply.accumulate(down, out=down)


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers below n of the second base and of its inverse, modulo the prime."""
    return tuple(x[:n] for x in kept_prime_powers()) if n <= KEPT_POWERS else made_prime_powers(n)


@cache
def kept_prime_powers() -> tuple[np.ndarray, np.ndarray]:
    return made_prime_powers(KEPT_POWERS)


def made_prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = []
    for base in (PRIME_BASE, PRIME_INVERSE):
        out = np.ones(n, np.uint32)
        done = 1
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more].astype(np.uint64) * np.uint64(pow(base, done, PRIME)) % np.uint64(PRIME)
            done += more
        made.append(out)
    return made[0], made[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * MULTIPLIER
    return h ^ (h >> np.uint64(29))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows in a row, and row offsets (rows + 1); null rows are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word, and how many words each row has.

    A word's hash mixes its polynomials over two rings, from differences of
    prefix sums, so the work for each byte is a few array operations.
    """
    column = pc.fill_null(column, "")
    raw, offsets = text_buffer(pc.utf8_lower(column) if lower else column)
    rows = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    space = IS_SPACE[raw]
    begins = ~space
    begins[1:] &= space[:-1]
    # a row's first byte begins a word even after a word of the row before
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = ~space[firsts]
    finish = ~space
    finish[:-1] &= space[1:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    finish[lasts] = ~space[lasts]
    start, end = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    up, down = powers(len(raw) + 1)
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(BYTE_VALUES[raw] * up[: len(raw)], out=total[1:])
    hashes = (total[end] - total[start]) * down[start]
    up, down = prime_powers(len(raw) + 1)
    np.cumsum(PRIME_VALUES[raw] * up[: len(raw)] % np.uint64(PRIME), out=total[1:])
    second = (total[end] - total[start]) % np.uint64(PRIME) * down[start] % np.uint64(PRIME)
    hashes = mixed(hashes ^ mixed(second + np.uint64(1)))
    at = np.searchsorted(start, offsets)
    return hashes, np.diff(at)


def run_hashes(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of ``width`` words inside a row; a row with fewer words has one run of all of them."""
    rows = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    left = ends[rows] - np.arange(n)  # words from here to the row's end
    value = np.zeros(n, np.uint64)
    for i in range(min(width, n)):
        part = hashes[i:] * RUN_FACTORS[i]
        if i:
            value[: n - i] += np.where(left[: n - i] > i, part, np.uint64(0))
        else:
            value += part
    first = left == counts[rows]
    keep = (left >= width) | first
    return mixed(value[keep]), rows[keep]


def row_terms(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, 48-bit term) pairs in order, and their counts. Fewer than 65,536 rows."""
    key = np.sort((rows.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16)))
    if not len(key):
        return np.zeros(0, np.int64), key, np.zeros(0, np.int64)
    new = np.empty(len(key), bool)
    new[0] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    at = np.flatnonzero(new)
    key = key[at]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), np.diff(np.append(at, len(new)))


def small_pieces(column: pa.Array, most_bytes: int = 900_000, most_rows: int = 4096) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) with about ``most_bytes`` each, one row at least."""
    lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and (size + n > most_bytes or i - start >= most_rows):
            yield start, column.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(column):
        yield start, column.slice(start)
