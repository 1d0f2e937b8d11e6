"""Word scanning over whole Arrow batches with numpy, byte by byte.

Both word classes break at ASCII bytes only, and UTF-8 keeps ASCII bytes out of
longer characters, so working on bytes equals working on code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text bytes scanned at once; a longer single text is scanned alone.
CHUNK = 1 << 18

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xD6E8FEB86659FD93 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_BASE))
#: [^\x20\x09-\x0D]
SOLID = np.ones(256, bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_pow = (np.ones(1, U), np.ones(1, U))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow
    if len(_pow[0]) < n:
        with np.errstate(over="ignore"):
            up = np.full(n, U(_BASE))
            up[0] = 1
            down = np.full(n, U(pow(_BASE, -1, 1 << 64)))
            down[0] = 1
            both = np.cumprod(up), np.cumprod(down)
        if n > 4 * CHUNK:
            return both
        _pow = both
    return _pow


@dataclass
class Words:
    """Words of consecutive rows: byte bounds in ``buf``, and ``ptr`` from row to word."""

    lo: int
    hi: int
    buf: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def rows(self) -> np.ndarray:
        """The row of each word, from 0 in this chunk."""
        return np.repeat(np.arange(self.hi - self.lo), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.empty(0, U)
        up, down = _powers(len(self.buf) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(self.buf) + 1, U)
            np.cumsum(_BYTE[self.buf] * up[: len(self.buf)], out=sums[1:])
            h = (sums[self.end] - sums[self.start]) * down[self.start]
            return mix(h + (self.end - self.start).astype(U) * U(_GRAM))

    def grams(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words of a row, and the index of each first word."""
        n = len(h) - k + 1
        if n <= 0:
            return np.empty(0, U), np.empty(0, np.int64)
        last = np.repeat(self.ptr[1:], self.counts)[:n]
        at = np.flatnonzero(np.arange(n) + k <= last)
        return gram_hash(h, at, k), at

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def gram_hash(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        g = np.zeros(len(at), U)
        for j in range(k):
            g = g * U(_GRAM) + h[at + j]
        return mix(g + U(k) * U(_BASE))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) and not pa.types.is_large_binary(col.type) else b"")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def pieces(off: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``chunk`` bytes."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + chunk, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def scan(col: pa.Array, kind: np.ndarray = SOLID, lower: bool = True, chunk: int = CHUNK) -> Iterator[Words]:
    """Words of each row, a chunk of rows at a time. Every row is in one chunk."""
    off, data = text_buffers(col)
    for lo, hi in pieces(off, chunk):
        buf = data[off[lo] : off[hi]]
        if lower:
            buf = LOWER[buf]
        at = off[lo : hi + 1] - off[lo]
        mask = kind[buf]
        before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
        if len(buf):
            before[1:], after[:-1] = mask[:-1], mask[1:]
            inner = at[:-1][at[:-1] < len(buf)]
            before[inner] = False
            inner = at[1:][at[1:] > 0]
            after[inner - 1] = False
        start, end = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
        yield Words(lo, hi, buf, at, start, end, np.searchsorted(start, at))


def list_array(values: np.ndarray, ptr: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(values, kind))
