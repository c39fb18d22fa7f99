"""Words of Arrow string columns as 64-bit numbers, a piece of about a megabyte at a time.

A word is a maximal run of bytes outside a separator set. All separators are ASCII, so runs of
UTF-8 bytes and runs of characters are the same. A word's number depends on its lower-cased
(A-Z) bytes only: it is a polynomial in them modulo 2**64, taken from running sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
SPACES = bytes([0x20, *range(0x09, 0x0E)])  # what parts words in `[^\x20\x09-\x0D]+`
NOT_ALPHANUMERIC = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])  # after lower-casing

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_ANY = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number spread over all bits, one to one (the finaliser of splitmix64)."""
    x = x ^ (x >> _ANY(30))
    x *= _ANY(0xBF58476D1CE4E5B9)
    x ^= x >> _ANY(27)
    x *= _ANY(0x94D049BB133111EB)
    x ^= x >> _ANY(31)
    return x


def numbers(count: int, seed: int) -> np.ndarray:
    """``count`` fixed pseudo-random 64-bit numbers."""
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * _ANY(_BASE) + _ANY(seed))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = numbers(256, 11)[_LOWER]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE_BYTES, 1 << (n - 1).bit_length()) if n else PIECE_BYTES
    if size not in _powers:
        _powers.clear()
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


@dataclass
class Piece:
    """Consecutive rows of a column: their words' numbers, and where each row's words begin."""

    first: int
    words: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def _words_of(data: np.ndarray, breaks: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and number of every word; words also end at each of ``breaks``."""
    inside = ~separator[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    at = breaks[breaks < len(data)]
    starts[at] = inside[at]
    at = breaks[breaks > 0] - 1
    ends[at] = inside[at]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _power_tables(len(data))
    sums = _BYTE[data]
    sums *= power[: len(data)]
    np.cumsum(sums, out=sums)
    number = sums[last - 1]
    number[first > 0] -= sums[first[first > 0] - 1]
    number *= inverse[first]
    return first, mixed(number)


def pieces(column: pa.Array, separators: bytes) -> Iterator[Piece]:
    """The rows of a string column (null: empty) in pieces of about ``PIECE_BYTES``.

    A longer row is cut between words while it is read, so memory follows the piece and, for a
    single word above that size, the word.
    """
    separator = np.zeros(256, dtype=bool)
    separator[list(separators)] = True
    separator = separator[_LOWER]
    offsets, data = text_bytes(column)
    row, rows = 0, len(column)
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, side="right")) - 1
        stop = min(rows, max(stop, row + 1))
        begin, end = int(offsets[row]), int(offsets[stop])
        breaks = offsets[row : stop + 1] - begin
        if end - begin <= 2 * PIECE_BYTES:
            first, number = _words_of(data[begin:end], breaks, separator) if end > begin else (breaks[:0], np.zeros(0, np.uint64))
            yield Piece(row, number, np.searchsorted(first, breaks))
        else:
            parts = [_words_of(x, np.zeros(1, np.int64), separator)[1] for x in _cut(data[begin:end], separator)]
            number = np.concatenate(parts)
            yield Piece(row, number, np.array([0, len(number)]))
        row = stop


def _cut(data: np.ndarray, separator: np.ndarray) -> Iterator[np.ndarray]:
    """One long row in parts that end with a separator."""
    at = 0
    while at < len(data):
        stop = min(len(data), at + PIECE_BYTES)
        while stop < len(data):
            found = np.flatnonzero(separator[data[stop : stop + PIECE_BYTES]])
            if len(found):
                stop += int(found[0]) + 1
                break
            stop = min(len(data), stop + PIECE_BYTES)
        yield data[at:stop]
        at = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and UTF-8 bytes of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """The number of every run of ``n`` consecutive words; runs of other lengths have others."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = words[:count].copy()
    for j in range(1, n):
        total *= _ANY(_BASE)
        total += words[j : j + count]
    total += _ANY(n)
    return mixed(total)


def shingles(piece: Piece, n: int) -> Iterator[np.ndarray]:
    """For each row its runs of ``n`` words; fewer words are one run, no words none."""
    every = grams(piece.words, n)
    for a, b in zip(piece.offsets[:-1].tolist(), piece.offsets[1:].tolist()):
        if b - a >= n:
            yield every[a : b - n + 1]
        else:
            yield grams(piece.words[a:b], b - a) if b > a else every[:0]
