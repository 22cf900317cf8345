"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of distinct word shingles. For a
partition of items of up to 2^c shingles a document is read in overlapping
windows of 2^(c+1), so that a short item is never compared with a whole long
document: the likeness of an item to a window that holds it stays high enough
for one shared minimum among ``functions`` to find it all but surely. Items of
up to ``SHORT`` shingles are looked up by as many of their hashes as a leak cannot
all lack, which finds them with certainty. Every candidate is verified by exact containment of the item's shingles in the whole
document, hash by hash and then string by string.

Words are runs of other than white space with A-Z in lower case. The items are a
stated query set: they go to the tasks in blocks of at most ``block_items``.

Defined results: null text counts as empty; an item of fewer than ``k`` words has
no shingles and is never found; a null doc_id is reported as null; repeated rows
are reported each, repeated items too. Extra columns pass through or are
ignored; an empty table or benchmark gives no leaks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm._text import Words, raw, row_slices, shingle_hashes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Shingles of the items that are looked up by their hashes.
SHORT = 8
LEAKS = "doc_id long, item_id long, n_shared long, n_shingles long, containment double"


def lower_words(texts: pa.Array) -> Words:
    data, offsets = raw(texts)
    return Words(LOWER[data], offsets)


class Items:
    """One block of test items, ready to be searched for."""

    def __init__(self, ids: list[int], texts: list[str], k: int, functions: int, threshold: float):
        self.k, self.threshold = k, threshold
        words = lower_words(pa.array(texts, pa.string()))
        hashes, text = shingle_hashes(words.hashes(), k), words.data.tobytes()
        seeds = np.random.default_rng(11).integers(1, 2**63, (2, functions), dtype=np.uint64)
        self.factors, self.terms = seeds[0] | np.uint64(1), seeds[1]
        self.ids, self.hashes, self.strings = [], [], []
        for i, item in enumerate(ids):
            own = range(int(words.first[i]), int(words.first[i + 1]) - k + 1)
            if len(own):
                self.ids.append(item)
                self.hashes.append(np.unique(hashes[own.start : own.stop]))
                self.strings.append({text[words.start[j] : words.start[j + k] - 1] for j in own})
        self.partitions = []
        sizes = np.array([len(h) for h in self.hashes], int)
        short = [(h, m) for m in np.flatnonzero(sizes <= SHORT).tolist() for h in self.hashes[m][: self.lookups(int(sizes[m]))].tolist()]
        short.sort()
        self.short = np.array([x[0] for x in short], np.uint64), [x[1] for x in short]
        exponents = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
        for c in sorted(set(exponents[sizes > SHORT].tolist())):
            members = np.flatnonzero((sizes > SHORT) & (exponents == c))
            minima = np.array([[int((self.hashes[m] * a + b).min()) for a, b in zip(self.factors, self.terms, strict=True)] for m in members], np.uint64)
            tables = []
            for f in range(functions):
                order = np.argsort(minima[:, f], kind="stable")
                tables.append((minima[order, f], members[order]))
            self.partitions.append((1 << c, tables))

    def lookups(self, size: int) -> int:
        """Of so many of an item's hashes a leak has one at least."""
        return min(size, size - math.ceil(self.threshold * size - 1e-9) + 1)

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs that share a short item's hash or a minimum in some window; text d has hashes first[d]..first[d + 1]."""
        found: set[tuple[int, int]] = set()
        n = np.diff(first)
        keys, members = self.short
        lo, hi = np.searchsorted(keys, hashes), np.searchsorted(keys, hashes, side="right")
        hits = np.flatnonzero(hi > lo)
        for d, i in zip((np.searchsorted(first, hits, side="right") - 1).tolist(), hits.tolist(), strict=True):
            found.update((d, m) for m in members[lo[i] : hi[i]])
        if not self.partitions:
            return found
        for f, (a, b) in enumerate(zip(self.factors, self.terms, strict=True)):
            values = hashes * a + b
            width, starts, counts = 1, first[:-1], n  # blocks of the level before
            for size, tables in self.partitions:
                # blocks of this level gather those of the level before
                ratio = size // width
                blocks = -(-counts // ratio)
                owner = np.repeat(np.arange(len(n)), blocks)
                base = np.concatenate([[0], np.cumsum(blocks)])
                within = np.arange(base[-1]) - base[owner]
                values = np.minimum.reduceat(values, starts[owner] + within * ratio) if len(owner) else values[:0]
                width, starts, counts = size, base[:-1], blocks
                pair = values.copy()
                if len(owner) > 1:
                    near = owner[1:] == owner[:-1]
                    pair[:-1][near] = np.minimum(values[:-1], values[1:])[near]
                keys, members = tables[f]
                lo, hi = np.searchsorted(keys, pair), np.searchsorted(keys, pair, side="right")
                for w in np.flatnonzero(hi > lo).tolist():
                    found.update((int(owner[w]), m) for m in members[lo[w] : hi[w]].tolist())
        return found

    def leaks(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(text, item id, shared shingles, the item's shingles) of each leak in a slice."""
        words = lower_words(texts)
        starts = words.shingle_starts(self.k)
        if not len(starts) or not self.ids:
            return []
        hashes = shingle_hashes(words.hashes(), self.k)[starts]
        first = np.searchsorted(starts, words.first)
        out = []
        text = None
        for d, m in sorted(self.candidates(hashes, first)):
            own = hashes[first[d] : first[d + 1]]
            if np.isin(self.hashes[m], own).sum() < self.threshold * len(self.hashes[m]) - 1e-9:
                continue
            text = text or words.data.tobytes()
            at = starts[first[d] : first[d + 1]][np.isin(own, self.hashes[m])]
            shared = len({text[words.start[j] : words.start[j + self.k] - 1] for j in at.tolist()} & self.strings[m])
            if shared >= self.threshold * len(self.strings[m]) - 1e-9:
                out.append((d, self.ids[m], shared, len(self.strings[m])))
        return out


#: Bytes of test items that are broadcast at a time, beside their number.
BLOCK_BYTES = 16 << 20


def item_blocks(benchmark: DataFrame, block_items: int) -> Iterator[tuple[list[int], list[str]]]:
    """The test items in blocks of about ``block_items`` and ``BLOCK_BYTES`` at most, one at a time on the driver."""
    items, size = benchmark.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(1, math.ceil(items / block_items), math.ceil((size or 0) / BLOCK_BYTES))
    for block in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).toArrow()
        yield part.column("item_id").to_pylist(), part.column("text").to_pylist()


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, functions: int = 64, block_items: int = 20_000) -> DataFrame:
    """A row for each document and each test item of which it holds ``threshold`` or more."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def search(block: tuple[list[int], list[str]]) -> DataFrame:
        shared = sc.broadcast((*block, k, functions, threshold))  # one block of items

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value)
            for batch in batches:
                for part in row_slices(batch):
                    found = items.leaks(part.column("text"))
                    rows = pa.array([x[0] for x in found], pa.int64())
                    n, size = np.array([x[2] for x in found], np.int64), np.array([x[3] for x in found], np.int64)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(rows), pa.array([x[1] for x in found], pa.int64()), pa.array(n), pa.array(size), pa.array(n / np.maximum(size, 1), pa.float64())], [x.split()[0] for x in LEAKS.split(", ")])

        return docs.mapInArrow(run, LEAKS)

    out = None
    for block in item_blocks(benchmark, block_items):
        found = search(block)
        out = found if out is None else out.unionAll(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, functions: int = 64, block_items: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that hold no test item, unchanged."""
    sc = docs.sparkSession.sparkContext
    columns = docs.columns

    def clean(docs: DataFrame, block: tuple[list[int], list[str]]) -> DataFrame:
        shared = sc.broadcast((*block, k, functions, threshold))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value)
            for batch in batches:
                for part in row_slices(batch):
                    keep = np.ones(part.num_rows, bool)
                    keep[[x[0] for x in items.leaks(part.column("text"))]] = False
                    yield part.filter(pa.array(keep))

        return docs.select(*columns).mapInArrow(run, docs.schema)

    for block in item_blocks(benchmark, block_items):
        docs = clean(docs, block)
    return docs
