"""Byte-level numpy kernels shared by the operators: chunks of whole texts, words, hashes of substrings.

A chunk is a group of whole texts in one flat byte array with a newline after each, so that temporary
arrays stay near CHUNK bytes times a small factor however many rows an Arrow batch holds; one text
longer than CHUNK is a chunk of its own. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _libc = None
#: The bytes of a 64-bit word that belong to a string with so many bytes left.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], U64)
_SEED, _CHAIN = U64(0x8F3B5A1E6C9D2471), U64(0x9E3779B97F4A7C15)
LONG = 256  # bytes from which a string is hashed by BLAKE2


@dataclass
class Chunk:
    lo: int  # rows of the batch
    hi: int
    texts: list[bytes]
    buf: np.ndarray  # texts, each followed by a newline
    start: np.ndarray
    end: np.ndarray

    def per_doc(self, at: np.ndarray) -> np.ndarray:
        """For sorted positions: how many lie in each text."""
        return np.diff(np.searchsorted(at, np.append(self.start, len(self.buf))))


ROWS = 512  # of a column that are Python strings at a time


def as_bytes(column: pa.Array) -> pa.Array:
    return column.cast(pa.binary())


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on, and its executor's share is small."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)
        give_back()


def chunks(texts: list[bytes] | pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    if not isinstance(texts, list):
        for at in range(0, len(texts), ROWS):
            for chunk in chunks([x or b"" for x in texts.slice(at, ROWS).to_pylist()], limit):
                chunk.lo, chunk.hi = chunk.lo + at, chunk.hi + at
                yield chunk
        give_back()
        return
    lo, size = 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or (i > lo and size + len(texts[i]) > limit):
            if i > lo:
                part = texts[lo:i]
                buf = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
                end = np.cumsum(np.array([len(x) + 1 for x in part], np.int64)) - 1
                yield Chunk(lo, i, part, buf, np.concatenate(([0], end[:-1] + 1)), end)
            lo, size = i, 0
        if i < len(texts):
            size += len(texts[i])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros after the end."""
    raw = buf.tobytes() + b"\0" * 8
    out = np.empty(len(raw), U64)
    for k in range(8):
        part = np.frombuffer(raw, "<u8", (len(raw) - k) // 8, k)
        out[k : k + 8 * len(part) : 8] = part
    return out[: len(buf) + 1]


class Strings:
    """Substrings of a buffer: their hashes, and numbers that are equal exactly for equal bytes."""

    def __init__(self, buf: np.ndarray):
        self.buf, self.eight = buf, eights(buf)

    def _rounds(self, n: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Offsets 8, 16, ... and which of the strings with n bytes, up to LONG, reach beyond them."""
        live = np.flatnonzero((n > 8) & (n <= LONG))
        k = 8
        while len(live):
            yield k, live
            k += 8
            live = live[n[live] > k]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes [start, end), eight a round through a bijection that spreads all bits."""
        n = end - start
        h = mix(mix(n.astype(U64) ^ _SEED) * _CHAIN + (self.eight[start] & _MASK[np.minimum(n, 8)]))
        for k, live in self._rounds(n):
            h[live] = mix(h[live] * _CHAIN + (self.eight[start[live] + k] & _MASK[np.minimum(n[live] - k, 8)]))
        for i in np.flatnonzero(n > LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.buf[start[i] : end[i]], digest_size=8).digest(), "little")
        return h

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n bytes from a and from b are equal."""
        out = ((self.eight[a] ^ self.eight[b]) & _MASK[np.minimum(n, 8)]) == 0
        for k, live in self._rounds(n):
            out[live] &= ((self.eight[a[live] + k] ^ self.eight[b[live] + k]) & _MASK[np.minimum(n[live] - k, 8)]) == 0
        for i in np.flatnonzero(n > LONG).tolist():
            out[i] = a[i] == b[i] or np.array_equal(self.buf[a[i] : a[i] + n[i]], self.buf[b[i] : b[i] + n[i]])
        return out

    def ids(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number for each string, equal for equal bytes only, and the index of the first string of each number."""
        _, first, back = np.unique(self.hash(start, end), return_index=True, return_inverse=True)
        n, lead = end - start, first[back]
        fits = (n == n[lead]) & self.same(start, start[lead], np.minimum(n, n[lead]))
        if not fits.all():  # two strings share a hash: go by the bytes
            known: dict[bytes, int] = {}
            back = np.array([known.setdefault(self.buf[a:b].tobytes(), len(known)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
            first = np.unique(back, return_index=True)[1]
        return back, first


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than 0x20 and 0x09 to 0x0D."""
    gap = np.concatenate(([True], SPACE[buf], [True]))
    return np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])


def grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n neighbouring items with hashes h in the same text, and the index of the first item of each."""
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    out = h[at].copy()
    for k in range(1, n):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[at + k])
    return out, at
