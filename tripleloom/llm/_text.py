"""Vectorised word handling for one Arrow slice of texts.

All helpers work on the UTF-8 bytes of a whole slice at once, so their cost per
document is a few numpy calls and their memory is bounded by the slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once.
SLICE_BYTES = 4 << 20

#: The separators of the word pattern ``[^\x20\x09-\x0D]+``.
SPACES = bytes([0x20, *range(0x09, 0x0E)])

_WEIGHTS = np.random.default_rng(0x5EED).integers(1, 2**63, 1 << 16, dtype=np.uint64) | np.uint64(1)


def byte_set(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


SPACE_TABLE = byte_set(SPACES)


def row_slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``max_bytes`` of text (or one row)."""
    if not batch.num_rows:
        return
    offsets = raw(batch.column(column))[1]
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string array; a null counts as empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if buffers[1] else np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64) - int(offsets[0])


class Words:
    """The words of a slice of texts.

    ``data`` holds the words one after another, each followed by ``sep`` bytes
    of space; word i is ``data[start[i] : start[i + 1] - sep]``; the words of
    text d are ``first[d]`` to ``first[d + 1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, spaces: np.ndarray = SPACE_TABLE, sep: int = 1, inside: np.ndarray | None = None):
        """Words are runs of bytes that are not in ``spaces``, or for which ``inside`` holds."""
        self.sep = sep
        inside = ~spaces[data] if inside is None else inside
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before, after = edge[:-1].copy(), edge[1:].copy()
        before[1:] |= ~inside[:-1]
        after[:-1] |= ~inside[1:]
        begin, end = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
        self.lens = end - begin
        self.first = np.searchsorted(begin, offsets)
        self.compact = data[inside]
        self.count = len(begin)
        self.compact_start = np.concatenate([[0], np.cumsum(self.lens)])
        self.start = self.compact_start + sep * np.arange(self.count + 1)
        if sep:
            self.data = np.full(int(self.start[-1]), 0x20, np.uint8)
            self.data[np.arange(len(self.compact)) + np.repeat(np.arange(self.count), self.lens)] = self.compact
        else:
            self.data = self.compact

    def strings(self) -> pa.StringArray:
        """The words as an Arrow array (needs ``sep=0``)."""
        return pa.StringArray.from_buffers(self.count, pa.py_buffer(self.start.astype(np.int32)), pa.py_buffer(self.data))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same for equal words anywhere."""
        if not self.count:
            return np.zeros(0, np.uint64)
        place = np.arange(len(self.compact)) - np.repeat(self.compact_start[:-1], self.lens)
        terms = (self.compact.astype(np.uint64) + np.uint64(1)) * _WEIGHTS[place & 0xFFFF]
        return mix(np.add.reduceat(terms, self.compact_start[:-1]) + self.lens.astype(np.uint64))

    def shingle_starts(self, k: int) -> np.ndarray:
        """Indices of the words at which k words of one text begin."""
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(self.count)
        return np.flatnonzero(left >= k)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes, at the index of its first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * _WEIGHTS[1000 + j]
    return mix(total)


def counts_of(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each run ``first[d]``..``first[d + 1]`` (empty: 0)."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
