"""Bounded-space online packing of token sequences into windows of fixed length.

Each partition encodes its documents (ids and one closing id), cuts a document
longer than a window into whole windows and a rest, and places every piece in
the fullest of at most ``open_windows`` open windows in which it fits (best
fit). When none fits and all are in use, the fullest is emitted. What is still
open at a partition's end is merged: a bounded number of partitions' leftovers
at a time are packed anew, largest piece first.

Null text counts as empty: such a document is its closing id alone. Repeated
rows are packed each. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm._session import durable
from tripleloom.llm._text import SLICE_BYTES, Words, raw
from tripleloom.llm.token_counts import SAFE, pieces, word_encoder

#: sequence_id is (partition << SEQUENCE_BITS) + the number within it; merged ones are negative.
SEQUENCE_BITS = 32

FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, leftover boolean"
NAMES = [x.split()[0] for x in FIELDS.split(", ")]


class OpenWindows:
    """At most ``most`` open windows; ``free`` has a bit for each free length in use."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.count, self.free = size, most, 0, 0
        self.by_free: dict[int, list[list]] = {}

    def _take(self, free: int) -> list:
        stack = self.by_free[free]
        window = stack.pop()
        if not stack:
            self.free &= ~(1 << free)
        self.count -= 1
        return window

    def place(self, piece: tuple, length: int) -> list | None:
        """Place a piece; return a window that had to leave or is now full."""
        fits = self.free >> length
        out = None
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            window = self._take(free)
        else:
            if self.count >= self.most:
                out = self._take((self.free & -self.free).bit_length() - 1)
            free, window = self.size, []
        window.append(piece)
        free -= length
        if free == 0:
            return window if out is None else out + [None] + window
        self.by_free.setdefault(free, []).append(window)
        self.free |= 1 << free
        self.count += 1
        return out

    def rest(self) -> list[list]:
        return [w for stack in self.by_free.values() for w in stack]


def encoded(batch: pa.RecordBatch, encoder, end_id: int, max_bytes: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids with the closing id) of each text."""
    data, offsets = raw(batch.column("text"))
    parts: list[np.ndarray] = []
    end = np.array([end_id], np.uint32)
    at = 0
    for rows, part, bounds in pieces(data, offsets, max_bytes):
        words = Words(part, bounds, SAFE, sep=0)
        ids, of_word = encoder.ids(words)
        cuts = of_word[words.first].tolist()
        for k, row in enumerate(rows.tolist()):
            while at < row:  # rows before it are complete
                yield at, np.concatenate([*parts, end])
                parts, at = [], at + 1
            parts.append(ids[cuts[k] : cuts[k + 1]])
    while at < batch.num_rows:
        yield at, np.concatenate([*parts, end])
        parts, at = [], at + 1


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, open_windows: int = 32, end_id: int = 2, merge_partitions: int = 16, max_bytes: int = SLICE_BYTES, with_ids: bool = False) -> DataFrame:
    """A row for each piece: where its ids come from and where they lie.

    ``with_ids`` adds the ids themselves (array<int>); each piece's
    ``ids_crc32`` is over its ids as little-endian unsigned 32-bit numbers.
    """
    fields = FIELDS + (", ids array<int>" if with_ids else "")
    names = NAMES + ["ids"] * with_ids

    def rows_of(windows: list, number: int, leftover: bool) -> tuple[list[tuple], int]:
        out = []
        for w in windows:
            at = 0
            for doc, start, length, crc, total, ids in w:
                out.append((doc, start, length, crc, total, number, at, leftover, ids))
                at += length
            number += 1
        return out, number

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.bool_(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        windows = OpenWindows(window, open_windows)
        number = TaskContext.get().partitionId() << SEQUENCE_BITS
        full: list[list] = []
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for row, ids in encoded(batch, encoder, end_id, max_bytes):
                total = len(ids)
                ids = ids.astype("<u4", copy=False)
                for start in range(0, total, window):
                    part = ids[start : start + window]
                    piece = (doc_ids[row], start, len(part), zlib.crc32(part.tobytes()), total, part.astype(np.int32).tolist() if with_ids else None)
                    if len(part) == window:
                        full.append([piece])
                    elif done := windows.place(piece, len(part)):
                        if None in done:
                            k = done.index(None)
                            full += [done[:k], done[k + 1 :]]
                        else:
                            full.append(done)
            rows, number = rows_of(full, number, False)
            full = []
            if rows:
                yield to_batch(rows)
        rows, number = rows_of(windows.rest(), number, True)
        if rows:
            yield to_batch(rows)

    # durable: the emitted windows and the leftovers come from one run of the packing
    placed = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(place, fields))

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        """Pack one group's leftover pieces anew, largest first."""
        cols = [table.column(n).to_pylist() for n in NAMES] + [table.column("ids").to_pylist() if with_ids else [None] * table.num_rows]
        order = sorted(range(table.num_rows), key=lambda i: (-cols[2][i], cols[5][i], cols[6][i]))
        windows, full = OpenWindows(window, 1 << 62), []
        for i in order:
            piece = (cols[0][i], cols[1][i], cols[2][i], cols[3][i], cols[4][i], cols[8][i])
            if done := windows.place(piece, piece[2]):
                full.append(done)
        rows, _ = rows_of(full + windows.rest(), -((int(key[0].as_py()) + 1) << SEQUENCE_BITS), False)
        return pa.Table.from_batches([to_batch(rows)])

    group = F.shiftright("sequence_id", SEQUENCE_BITS).alias("partition")
    loose = placed.where("leftover").withColumn("merge_group", F.floor(group / merge_partitions).cast("long"))
    merged = loose.groupBy("merge_group").applyInArrow(merge, fields)
    return placed.where("NOT leftover").unionByName(merged).drop("leftover")
