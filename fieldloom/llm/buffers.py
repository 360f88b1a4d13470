"""Texts and words as flat arrays over Arrow buffers, without a Python object a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .hashing import digest16, mix

SPACE_BYTES = [0x20, *range(0x09, 0x0E)]
#: Longer words are hashed and compared one by one, shorter ones eight bytes at a time together.
LONG_WORD = 64
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros beyond the end."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), 0, (1,))


def flat_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column's texts and where each begins, with one more: a view of its buffers."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


class BufferWords:
    """Words of several texts with the text, hash and eight-byte parts of each."""

    def __init__(self, data: np.ndarray, space: np.ndarray, at: np.ndarray):
        inside, self.data = ~space, data
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= space[:-1]
        ends[:-1] &= space[1:]
        borders = at[:-1][np.diff(at) > 0]
        begins[borders] = inside[borders]
        ends[at[1:][np.diff(at) > 0] - 1] |= inside[at[1:][np.diff(at) > 0] - 1]
        self.start = np.flatnonzero(begins)
        self.size = np.flatnonzero(ends) + 1 - self.start
        self.text = np.searchsorted(at, self.start, "right") - 1
        self.eights = eights(data)
        self.short = self.size <= LONG_WORD
        self.hash = self._hashes()

    def __len__(self) -> int:
        return len(self.start)

    def bytes(self, k: int) -> bytes:
        return self.data[self.start[k] : self.start[k] + self.size[k]].tobytes()

    def part(self, words: np.ndarray, k: int) -> np.ndarray:
        """The k-th eight bytes of words that are longer than 8 * k."""
        return self.eights[self.start[words] + 8 * k] & LOW_BYTES[np.minimum(self.size[words] - 8 * k, 8)]

    def _hashes(self) -> np.ndarray:
        out = self.size.astype(np.uint64)
        some = np.flatnonzero(self.short)
        for k in range(LONG_WORD // 8):
            some = some[self.size[some] > 8 * k]
            out[some] = mix(out[some] ^ self.part(some, k))
        for w in np.flatnonzero(~self.short).tolist():
            out[w] = int.from_bytes(digest16(self.bytes(w))[:8], "little")
        return out

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words a have the bytes of the words b."""
        out = self.size[a] == self.size[b]
        some = np.flatnonzero(out & self.short[a])
        for k in range(LONG_WORD // 8):
            some = some[self.size[a[some]] > 8 * k]
            out[some] &= self.part(a[some], k) == self.part(b[some], k)
        for n in np.flatnonzero(out & ~self.short[a]).tolist():
            out[n] = self.bytes(a[n]) == self.bytes(b[n])
        return out


def row_slices(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in parts with about size bytes of text in column, one row at least."""
    for batch in batches:
        _, at = flat_texts(batch.column(column))
        first = 0
        while first < len(batch):
            last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last
