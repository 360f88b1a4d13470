"""Vectorised hashes of words, word windows and byte windows over flat arrays.

Ranges are hashed by polynomials modulo the prime 2**61 - 1. Modulo a power of two, words that follow the Thue-Morse
sequence would all collide, whatever the base. Two bases give two hashes that are independent of one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

U64 = np.uint64
PRIME = (1 << 61) - 1
_P, _BITS, _HALF, _LOW = U64(PRIME), U64(61), U64(31), U64((1 << 31) - 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RANDOM = np.random.default_rng(20240607)
_BASES = [int(b) for b in _RANDOM.integers(1 << 40, PRIME - 1, 2)]
#: Positions whose ranges are hashed together: what they need stays in a processor's cache.
STRETCH = 1 << 16
#: Ranges of more bytes are hashed by a digest.
LONG = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & _P) + (x >> _BITS)
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """a * b modulo the prime, both below it, from products of their halves."""
    ah, al, bh, bl = a >> _HALF, a & _LOW, b >> _HALF, b & _LOW
    middle = ah * bl + al * bh
    return _fold(((ah * bh) << U64(1)) + (middle >> U64(30)) + ((middle & U64((1 << 30) - 1)) << _HALF) + al * bl)


def _powers(base: int, n: int, kept: dict = {}) -> np.ndarray:  # noqa: B006
    """base**0 ... base**(n - 1) modulo the prime, kept for the next call."""
    have = kept.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < n:
            have = np.concatenate((have, _times(have, U64(pow(base, len(have), PRIME)))))
        kept[base] = have
    return have[:n]


def _stretch_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    power = _powers(base, len(values))
    if values.dtype == np.uint8:
        v = values.astype(np.uint64) + U64(1)
        high, low = v * (power >> _HALF), v * (power & _LOW)
    else:
        t = _times(_fold(values), power)
        high, low = t >> _HALF, t & _LOW
    sums = np.zeros(len(values) + 1, np.uint64)
    top = _fold(np.cumsum(high, dtype=np.uint64))
    sums[1:] = _fold((top >> U64(30)) + ((top & U64((1 << 30) - 1)) << _HALF) + np.cumsum(low, dtype=np.uint64))
    part = _fold(sums[end] + (_P - sums[start]))
    size = (end - start).astype(np.uint64)
    return mix(_times(part, _powers(pow(base, -1, PRIME), len(values) + 1)[start]) + size * U64(0x9E3779B97F4A7C15))


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the ranges start to end of a sequence of bytes or 64-bit values: equal ranges have equal hashes.

    Starts must not descend. which chooses one of two independent hashes. Work goes stretch by stretch, so memory
    beyond the result doesn't follow the sequence's length.
    """
    out = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):
        b = int(np.searchsorted(start, start[a] + STRETCH, "left"))
        long = np.flatnonzero(end[a:b] - start[a:b] > LONG)
        if len(long):
            for k in (long + a).tolist():
                out[k] = int.from_bytes(digest16(values[start[k] : end[k]].tobytes())[8 * which : 8 * which + 8], "little")
        some = np.setdiff1d(np.arange(a, b), long + a) if len(long) else slice(a, b)
        if b - a > len(long):
            lo = int(start[a])
            out[some] = _stretch_hashes(values[lo : int(end[some].max())], start[some] - lo, end[some] - lo, _BASES[which])
        a = b
    return out


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in bytes whose last is a space."""
    space = _SPACE[data]
    before = np.empty(len(data), bool)
    before[:1], before[1:] = True, space[:-1]
    return np.flatnonzero(~space & before), np.flatnonzero(space & ~before)


class Words:
    """Words ([^\\x20\\x09-\\x0D]+) of several texts in one flat array."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        if lower:
            texts = [t.translate(_LOWER) for t in texts]
        self.data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.text_start = np.r_[0, np.cumsum(sizes)]
        self.start, self.end = word_bounds(self.data)
        #: First word of each text, and one more.
        self.first = np.searchsorted(self.start, self.text_start)
        self.hash = range_hashes(self.data, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def second_hash(self) -> np.ndarray:
        """Hashes of the words that are independent of hash."""
        return range_hashes(self.data, self.start, self.end, 1)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def digest16(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def text_slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with about size bytes of UTF-8 in column (null: empty), one row at least."""
    texts = batch.column(column).cast(pa.binary())
    lengths = [n or 0 for n in pa.compute.binary_length(texts).to_pylist()]
    taken = lambda a, b: [t or b"" for t in texts.slice(a, b - a).to_pylist()]
    start = total = 0
    for k, n in enumerate(lengths):
        if total and total + n > size:
            yield batch.slice(start, k - start), taken(start, k)
            start, total = k, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start), taken(start, len(lengths))
