"""Words and word windows of a batch of texts as numpy arrays.

Texts stay UTF-8 bytes. A word is a run of bytes other than space and 0x09-0x0D, which is
what ``[^\\x20\\x09-\\x0D]+`` matches. Words and windows of words are named by 64-bit
hashes: a polynomial with an odd base modulo 2**64 over random byte values, read off
running sums, and then mixed. Two different windows share a hash with a probability near
2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 17  # of text handled at once, which takes some 100 times as much memory; a longer text is a chunk of its own

_rng = np.random.Generator(np.random.Philox(key=20))
_BYTE = _rng.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = U64(0x9E3779B97F4A7C15 | 3)  # 3 modulo 4: small powers differ from 1 in few low bits
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_powers = {True: np.ones(1, dtype=U64), False: np.ones(1, dtype=U64)}


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers one to one."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base or of its inverse."""
    if len(_powers[inverse]) < n:
        step = np.full(max(n, 1 << 16), _INVERSE if inverse else _BASE, dtype=U64)
        step[0] = 1
        _powers[inverse] = np.cumprod(step, dtype=U64)
    return _powers[inverse][:n]


def running(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base**i, one longer than the input."""
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * powers(len(values)), out=out[1:], dtype=U64)
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], wherever it stands, from prefix sums."""
    back = powers(len(sums), inverse=True)
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


class Words:
    """The words of some texts: ``start``, ``end`` (byte positions), ``hash``; text i has the
    words ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets = data, offsets
        blank = np.ones(len(data) + 1, dtype=bool)
        blank[:-1] = _SPACE[data]
        head = ~blank[:-1]
        begins = head.copy()
        begins[1:] &= blank[:-2]
        edges = offsets[1:-1]
        edges = edges[edges < len(data)]
        begins[edges] = head[edges]  # a text ends a word
        self.start = np.flatnonzero(begins)
        last = head & blank[1:]
        edges = edges[edges > 0] - 1
        last[edges] = head[edges]
        self.end = np.flatnonzero(last) + 1
        self.sums = running((_LOWER if lower else _BYTE)[data])
        self.hash = between(self.sums, self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``length`` words that lie in one text, and their first words."""
        n = len(self.hash)
        if n < length:
            return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        sums = running(self.hash)
        at = np.arange(n - length + 1)
        stop = np.repeat(self.first[1:], self.count)[: len(at)]
        at = at[at + length <= stop]
        return between(sums, at, at + length), at


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into (first row, row after the last, bytes, offsets) of about ``size`` bytes."""
    data, offsets = utf8(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as a Spark long."""
    return h.view(np.int64)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` neighbours, the last of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, place, span = values, np.arange(len(values)), 1
    while span * 2 <= width:
        left, right = best[:-span], best[span:]
        take = right <= left
        best, place = np.where(take, right, left), np.where(take, place[span:], place[:-span])
        span *= 2
    rest = width - span
    if rest:
        left, right = best[: len(best) - rest], best[rest:]
        place = np.where(right <= left, place[rest:], place[: len(place) - rest])
    return place[:n]
