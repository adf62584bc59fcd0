"""Vectorised word hashing: whole Arrow string columns at a time, without a Python loop over words.

A word is a maximal run of bytes outside space and \\t..\\r. Its hash is a polynomial over a
random byte table modulo 2^64, taken from running sums, so the cost is a few array passes
whatever the number of words."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at a time; pieces end at white space, so no word is cut.
PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_UNBASE = pow(_BASE, -1, 2**64)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    factors = [np.full(n + 1, b, np.uint64) for b in (_BASE, _UNBASE)]
    for f in factors:
        f[0] = 1
    return tuple(np.cumprod(f, dtype=np.uint64) for f in factors)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in a new array)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and the n + 1 offsets of its rows; null rows are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


def chunks(column: pa.Array, most: int = PIECE):
    """Slices of rows of about ``most`` bytes (at least one row each): bounds the temporary arrays."""
    _, at = text_bytes(column)
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield begin, end
        begin = end


def word_bounds(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; rows never share one."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[at] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end = word
    end[:-1] &= ~word[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hash of each byte range; ranges are in order of their starts and need not be disjoint."""
    out = np.empty(len(starts), np.uint64)
    byte, i = (_BYTE_LOWER if lower else _BYTE), 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, lo + PIECE, "left")))
        hi = int(ends[i:j].max())
        up, down = _powers(max(PIECE + (1 << 16), hi - lo))
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(byte[buf[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def words_of(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column, and the n + 1 offsets of each row's words."""
    buf, at = text_bytes(column)
    starts, ends = word_bounds(buf, at)
    return range_hashes(buf, starts, ends, lower), np.searchsorted(starts, at)


def shingles_of(column: pa.Array, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's k-word shingles, and their n + 1 offsets. Fewer than
    k words make one shingle, none make none. Two different shingles of one text pair share a
    hash with a chance of about 2^-64."""
    h, at = words_of(column, lower)
    n = np.diff(at)
    sizes = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_at = np.concatenate([[0], np.cumsum(sizes)])
    rows = np.repeat(np.arange(len(n)), sizes)
    first = at[rows] + np.arange(out_at[-1]) - out_at[rows]
    g = np.zeros(len(first), np.uint64)
    last = at[rows + 1]
    for i in range(k):
        inside = first + i < last
        nxt = np.where(inside, h[np.minimum(first + i, len(h) - 1)] if len(h) else 0, np.uint64(i))
        g = mix((g ^ nxt) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i))
    keep = np.ones(len(g), bool)
    for a, b in zip(out_at[:-1], out_at[1:], strict=True):
        g[a:b].sort()
    keep[1:] = g[1:] != g[:-1]
    keep[out_at[:-1][sizes > 0]] = True
    kept_at = np.concatenate([[0], np.cumsum(keep)])[out_at]
    return g[keep], kept_at


class WordTable:
    """Hash table from 64-bit word hashes to row numbers, probed for whole arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.rows = np.full(1 << bits, -1, np.int64)

    def find(self, keys):
        """Row of each key, -1 where it isn't there."""
        mask = len(self.keys) - 1
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        rows = self.rows[at]
        rows[(rows >= 0) & (self.keys[at] != keys)] = -2
        open_ = np.flatnonzero(rows == -2)
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            got = self.rows[at[open_]]
            got[(got >= 0) & (self.keys[at[open_]] != keys[open_])] = -2
            rows[open_] = got
            open_ = open_[got == -2]
        return rows

    def add(self, keys, rows):
        """Distinct keys that are not there yet."""
        if (self.n + len(keys)) * 2 > len(self.keys):
            old, there = self, self.rows >= 0
            grown = WordTable(max(self.bits + 1, int((self.n + len(keys)) * 3).bit_length()))
            grown.add(old.keys[there], old.rows[there])
            self.bits, self.keys, self.rows, self.n = grown.bits, grown.keys, grown.rows, grown.n
        self.n += len(keys)
        mask = len(self.keys) - 1
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.rows[at] < 0
            self.rows[at[free]] = rows[todo[free]]  # the last of those at one slot stays
            won = free & (self.rows[at] == rows[todo])
            self.keys[at[won]] = keys[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & mask
