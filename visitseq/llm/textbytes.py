"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column."""

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 20

_MULTIPLIER = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = U64(pow(int(_MULTIPLIER), -1, 1 << 64))
_LETTERS = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_LETTERS[65:91] = _LETTERS[97:123]  # A-Z count as a-z
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x41:0x5B] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True


class Words(NamedTuple):
    """One entry a word, in text order: row of its text, byte range, hash of the word."""
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word (the public splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=2)
def _powers(base: int, size: int) -> np.ndarray:
    powers = np.full(size, U64(base))
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, kept for ordinary chunks."""
    size = max(2 * CHUNK_BYTES, 1 << (size + 1).bit_length())
    return _powers(int(_MULTIPLIER), size), _powers(int(_INVERSE), size)


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) with about ``max_bytes`` of text; a longer text is one slice.

    Nulls count as empty texts.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(column):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield first, column.slice(first, last - first)
        first = last


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string slice and the n + 1 offsets of its rows."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of members; a run never leaves its row."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    filled = offsets[:-1] < offsets[1:]
    begins, stops = offsets[:-1][filled], offsets[1:][filled] - 1
    start, end = member.copy(), member.copy()
    start[1:] &= ~member[:-1]
    end[:-1] &= ~member[1:]
    start[begins] |= member[begins]
    end[stops] |= member[stops]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(column: pa.Array) -> Words:
    """Maximal runs of ASCII letters, digits and non-ASCII characters; A-Z as a-z.

    Works on UTF-8 bytes: every byte of a non-ASCII character is 0x80 or more.
    """
    data, offsets = text_bytes(column)
    start, end = runs(_IS_WORD[data], offsets)
    powers, inverse = _tables(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * powers[:len(data)], out=prefix[1:])
    sums = (prefix[end] - prefix[start]) * inverse[start]
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(row, start, end, mix(sums + (end - start).astype(np.uint64)))


def grams(hashes: np.ndarray, rows: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93
          ) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and whether they are all in one row."""
    size = max(0, len(hashes) - n + 1)
    total, power = np.zeros(size, np.uint64), 1
    for i in range(n):
        total += hashes[i:i + size] * U64(power)
        power = power * base % (1 << 64)
    return mix(total), rows[:size] == rows[n - 1:n - 1 + size]
