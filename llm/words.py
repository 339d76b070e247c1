"""Words of a batch of texts as numpy arrays: places, hashes, hashes of runs of words.

Texts stay in Arrow's UTF-8 buffer; no Python string is made for a word. All hashes are 64-bit
polynomials modulo 2**64 followed by a bijective mix, so they depend on the words alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 20
_BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, at least n of them."""
    have = _POW.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + 1)
        base = _BASE[which]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, U(b))
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _POW[which] = (both[0], both[1])
    return have


@dataclass
class Words:
    """Words of several texts; words first[d]:first[d + 1] are text d's."""

    data: np.ndarray  # the bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def text(self, d: int) -> np.ndarray:
        return self.hashes[self.first[d] : self.first[d + 1]]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything but letters, digits and the bytes of longer characters.
_MARKS = np.ones(256, dtype=bool)
_MARKS[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _MARKS[_a:_b] = False


def blocks(column: pa.Array, size: int = BLOCK, separators: np.ndarray = _SPACE) -> Iterator[tuple[int, int, Words]]:
    """(from row, to row, words) for runs of rows of about `size` bytes. A null text has no words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        end = min(end, n)
        own = offsets[row : end + 1]
        yield row, end, words_of(data[own[0] : own[-1]], own - own[0], separators)
        row = end


def words_of(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> Words:
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(data, empty, empty, np.zeros(len(offsets), np.int64), np.zeros(0, U))
    gap = separators[data]
    inside = ~gap
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= gap[:-1]
    stop[:-1] &= gap[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    begin[full] = inside[full]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    stop[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    p, q = powers(0, n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * p[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(U) * U(_BASE[1]))
    return Words(data, starts, ends, np.searchsorted(starts, offsets), hashes)


def runs(hashes: np.ndarray, k: int, which: int = 1) -> np.ndarray:
    """Hashes of the k consecutive words that start at each word, len - k + 1 of them."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U)
    p, q = powers(which, n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(hashes * p[:n], out=total[1:])
    return mix((total[k:] - total[: n - k + 1]) * q[: n - k + 1] + U(k))


def whole(first: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For runs of k words at each of n - k + 1 words: the text of each, and whether it ends in that text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[: max(0, n - k + 1)]
    return text, np.arange(len(text)) + k <= first[1:][text]


def in_sorted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted table."""
    if not len(table):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
