"""Vectorised text helpers: UTF-8 bytes of an Arrow batch as numpy arrays.

Words are maximal runs of bytes outside space and \\x09-\\x0D; these are ASCII,
so the split is the same on bytes and on code points.  Everything works on
slices of a bounded number of bytes, so memory doesn't follow the batch size;
only a single text longer than the slice makes a larger slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20
WORDS_PER_SHINGLE = 5

_MULT = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, xor and multiply), elementwise."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, mult: int = _MULT) -> np.ndarray:
    """mult ** i modulo 2**64 for i below n, kept between calls."""
    key = str(mult)
    have = _powers.get(key, np.ones(1, U))
    while len(have) < n:
        step = U(pow(mult, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _powers[key] = have
    return have[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows of at most limit bytes, or of one row."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; no word crosses a text's bounds."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | cut[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, whatever their place."""
    n = len(data)
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(n), out=sums[1:])
    inverse = pow(_MULT, -1, 1 << 64)
    h = (sums[ends] - sums[starts]) * powers(n, inverse)[starts]
    return mix(h ^ ((ends - starts).astype(U) * U(0xD6E8FEB86659FD93)))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WORDS_PER_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words, in order, and the row of each.

    A text of 1 to width-1 words has one shingle, all its words; a text
    without words has none.
    """
    starts, ends = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    edge = np.searchsorted(starts, offsets)
    count = np.diff(edge)
    many = np.where(count >= width, count - width + 1, 0)
    row = np.repeat(np.arange(len(count)), many)
    at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + edge[row]
    total = np.zeros(len(row), U)
    for j in range(width):
        total += mix(words[at + j] + U(j + 1)) * U(2 * j + 3)
    hashes = mix(total)
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        own = [mix(np.array([sum(int(x) * (2 * j + 3) for j, x in enumerate(mix(words[edge[r] : edge[r + 1]] + U(7)))) + int(count[r]) & (1 << 64) - 1], U))[0] for r in few]
        row, hashes = np.concatenate([row, few]), np.concatenate([hashes, np.array(own, U)])
        order = np.argsort(row, kind="stable")
        row, hashes = row[order], hashes[order]
    return hashes, row
