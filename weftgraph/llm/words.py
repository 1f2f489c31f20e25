"""Vectorised word arithmetic on raw UTF-8 buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  None of these
bytes occurs inside a multi-byte UTF-8 sequence, so everything here works on
bytes: a block of documents is one byte array plus offsets, and words and word
windows get 64-bit hashes from prefix sums (a polynomial over an odd base has
an inverse modulo 2**64, so the hash of any slice is a difference of two prefix
values times a power).  No Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes hashed at once; bounds the temporary arrays (about 40 times this).
BLOCK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift, three rounds)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(column: pa.Array, limit: int):
    """Row ranges of ``column`` holding about ``limit`` bytes, one row at least."""
    _, off = text_buffer(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = to


def spans(buf: np.ndarray, off: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each document's first word (n + 1)."""
    if len(buf) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~separator[buf]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    head, tail = off[:-1][off[:-1] < off[-1]], off[1:][off[1:] > 0] - 1
    starts[head] = inside[head]
    ends[tail] = inside[tail]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        m = int(ends[j - 1] - lo)
        up, down = powers(m + 1)
        sums = np.zeros(m + 1, U64)
        np.cumsum(_BYTE[buf[lo : lo + m]] * up[:m], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
        i = j
    return out


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ``size`` consecutive codes (documents are not looked at)."""
    n = len(codes)
    if n < size:
        return np.zeros(0, U64)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(codes * up[:n], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: n - size + 1] + U64(size))


def within(first: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of the windows of ``size`` words stay inside one document."""
    ok = np.ones(max(0, n - size + 1), bool)
    if size > 1 and len(ok):
        edge = np.zeros(n + 1, np.int32)
        cut = first[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        np.add.at(edge, cut, 1)
        crossed = np.cumsum(edge)
        ok = crossed[size - 1 : n] == crossed[: n - size + 1]
    return ok


def document_of(first: np.ndarray) -> np.ndarray:
    """The document index of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def totals(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one per word) per document."""
    out = np.zeros(len(first) - 1, np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.add.reduceat(values.astype(out.dtype, copy=False)[: first[-1]], first[full])
    return out


class Index:
    """Positions of 64-bit keys in an array of distinct keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(8, int(4 * max(1, len(keys))).bit_length())
        self.shift = U64(64 - bits)
        self.mask = (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            lost = self.table[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(_BASE)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is; -1 for those that are not there."""
        out = np.empty(len(keys), np.int32)
        for lo in range(0, len(keys), BLOCK):
            k = keys[lo : lo + BLOCK]
            slot = self._slot(k)
            at = self.table[slot]
            wrong = np.flatnonzero((at >= 0) & (self.keys[at] != k)) if len(self.keys) else np.zeros(0, np.int64)
            while len(wrong):
                slot[wrong] = (slot[wrong] + 1) & self.mask
                at[wrong] = self.table[slot[wrong]]
                wrong = wrong[(at[wrong] >= 0) & (self.keys[at[wrong]] != k[wrong])]
            out[lo : lo + BLOCK] = at
        return out
