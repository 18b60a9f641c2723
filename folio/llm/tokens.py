"""Words, word hashes and grams of Arrow string columns, in NumPy over the UTF-8 buffers.

All separators are ASCII, so bytes can be classed one by one. Work goes in pieces of a few megabytes,
whatever the size of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values over each other (the finisher of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


mixed = _mixed
_BYTE = _mixed((np.arange(1, 257, dtype=np.uint64)) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93  # odd, so its powers keep every bit
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            p = np.full(max(n, 2 * len(_POWERS), 256), _BASE, np.uint64)
            p[0] = 1
            _POWERS = np.cumprod(p)
    return _POWERS[:n]


_INVERSE = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    """What the first n powers of the base multiply to 1 with, modulo 2**64."""
    global _INVERSE
    if len(_INVERSE) < n:
        with np.errstate(over="ignore"):
            p = np.full(max(n, 2 * len(_INVERSE), 256), pow(_BASE, -1, 1 << 64), np.uint64)
            p[0] = 1
            _INVERSE = np.cumprod(p)
    return _INVERSE[:n]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: all but space and x09 to x0D.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words: digits, small letters after lower-casing, and all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


@dataclass
class Words:
    """Words of several texts: `data` has all bytes, lower-cased; word i is data[start[i]:end[i]];
    text d has the words first[d] to first[d + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        if len(self.data) <= 4 * PIECE:
            # Sums from the beginning of the piece; their differences are divided by the power of the word's place, which the odd base allows.
            with np.errstate(over="ignore"):
                sums = np.r_[_U(0), np.cumsum(_BYTE[self.data] * powers(len(self.data))[: len(self.data)])]
                return _mixed((sums[self.end] - sums[self.start]) * inverse_powers(len(self.data))[self.start])
        size = self.end - self.start
        at = np.cumsum(size) - size
        index = np.arange(int(size.sum()))
        inside = index - np.repeat(at, size)
        taken = self.data[inside + np.repeat(self.start, size)]
        with np.errstate(over="ignore"):
            return _mixed(np.add.reduceat(_BYTE[taken] * powers(int(size.max()))[inside], at))


def pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of runs of texts of about limit bytes; a longer text is a run of its own. Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    if pa.types.is_string(texts.type):
        kind = np.int32
    else:
        texts, kind = texts.cast(pa.large_string()), np.int64
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED) -> Words:
    data = _LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1 : n + 1] = kind[data]
    cut = np.zeros(n + 1, bool)  # a text begins here
    cut[offsets] = True
    edge = inside[1:] & (~inside[:-1] | cut)
    start = np.flatnonzero(edge[:n])
    end = np.flatnonzero(inside[1 : n + 1] & (~inside[2:] | cut[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words by their first word, and whether all k are of one text."""
    n = len(hashes)
    out, ok = np.zeros(n, np.uint64), np.zeros(n, bool)
    if n < k:
        return out, ok
    with np.errstate(over="ignore"):
        for j in range(k):
            out[: n - k + 1] += hashes[j : n - k + 1 + j] * powers(k)[j]
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ok[: n - k + 1] = owner[: n - k + 1] == owner[k - 1 :]
    return _mixed(out), ok


def longs(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Arrow longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
