"""Removal of repeated passages by super-k-mer partitioning.

A window is ``width`` consecutive words of one text. Each text is cut into runs
of consecutive windows that share a minimiser (the least hash of the
``minimiser``-word runs inside a window); a run travels as one packed string to
the bucket of its minimiser, so equal windows always meet. In a bucket the
windows are sorted and, wherever two fall together, compared byte by byte: the
least doc_id of each word sequence is exact. Words covered by a window that also
starts in a document with a smaller doc_id are then removed.

Runs that are equal within one slice of the input are settled there: only those
of the smallest doc_id travel, so a passage that fills a third of the input sends
a bucket at most one run a slice.

Defined results: null text counts as empty; a row with a null doc_id has no
order, so it loses nothing and removes nothing; rows that repeat a doc_id are
the same document and do not remove each other's words; texts of fewer than
``width`` words stay whole. Extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm._session import shuffle_partitions
from tripleloom.llm._text import SLICE_BYTES, Words, counts_of, raw, row_slices, shingle_hashes

#: A run that travels, or (settled) words known to be removed.
RUNS = "bucket int, settled boolean, runs int, places binary, packed binary, packed_bytes int"
NAMES = [x.split()[0] for x in RUNS.split(", ")]
KINDS = (pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.int32())
REMOVED = "doc_id long, version int, first int, end int"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:n], values[width - span : width - span + n])


def squeeze(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def places_of(doc: np.ndarray, *others: np.ndarray) -> bytes:
    """doc_ids (as differences) and 32-bit columns of some runs, packed."""
    return squeeze(b"".join([np.diff(doc, prepend=0).astype("<i8").tobytes(), *(x.astype("<i4").tobytes() for x in others)]))


def read_places(packed: pa.Buffer, n: int, others: int) -> list[np.ndarray]:
    data = pa.decompress(packed, decompressed_size=n * (8 + 4 * others), codec="zstd", asbytes=True)
    return [np.cumsum(np.frombuffer(data, "<i8", n)), *(np.frombuffer(data, "<i4", n, 8 * n + 4 * n * k) for k in range(others))]


def runs_of(batch: pa.RecordBatch, width: int, minimiser: int, buckets: int) -> pa.RecordBatch | None:
    """The packed runs of one slice of documents, one row for each bucket."""
    words = Words(*raw(batch.column("text")))
    starts = words.shingle_starts(width)
    doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    if batch.column("doc_id").null_count:
        ordered = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        starts = starts[np.repeat(ordered, np.diff(words.first))[starts]]
        doc_ids = np.where(ordered, doc_ids, 0).astype(np.int64)
    if not len(starts):
        return None
    least = sliding_min(shingle_hashes(words.hashes(), minimiser), width - minimiser + 1)[starts]
    # a text's last windows end with it, so starts of different texts are never consecutive
    breaks = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (least[1:] != least[:-1])]))
    begin, last = starts[breaks], starts[np.concatenate([breaks[1:] - 1, [len(starts) - 1]])]
    row = np.searchsorted(words.first, begin, side="right") - 1
    end = last + width
    first = begin - words.first[row]
    doc, version = doc_ids[row], batch.column("version").to_numpy()[row]
    text = words.data.tobytes()
    packed = [text[a:b] for a, b in zip(words.start[begin].tolist(), (words.start[end] - 1).tolist(), strict=True)]
    codes = pa.array(packed, pa.binary()).dictionary_encode().indices.to_numpy()
    smallest = np.full(int(codes.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, codes, doc)
    travels = doc == smallest[codes]
    bucket = (least[breaks] % np.uint64(buckets)).astype(np.int64)
    rows = []
    going = np.flatnonzero(travels)
    going = going[np.argsort(bucket[going], kind="stable")]
    cuts = np.flatnonzero(np.diff(bucket[going], prepend=-1, append=-1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        some = going[a:b]
        text = b"\n".join([packed[i] for i in some.tolist()])
        rows.append((int(bucket[some[0]]), False, len(some), places_of(doc[some], version[some], first[some]), squeeze(text), len(text)))
    if not travels.all():
        some = np.flatnonzero(~travels)
        rows.append((int(bucket[some[0]]), True, len(some), places_of(doc[some], version[some], first[some], (first + end - begin)[some]), None, 0))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(KINDS)], NAMES)


def repeats_in(rows: list[dict], width: int) -> tuple[np.ndarray, ...]:
    """doc_id, version, first and end word of what the given buckets' windows remove."""
    doc, version, first = (np.concatenate(x) for x in zip(*(read_places(r["places"], r["runs"], 2) for r in rows), strict=True))
    data = b"\n".join([pa.decompress(r["packed"], decompressed_size=r["packed_bytes"], codec="zstd", asbytes=True) for r in rows])
    array = np.frombuffer(data, np.uint8)
    words = Words(array, np.concatenate([[0], np.flatnonzero(array == 0x0A) + 1, [len(array)]]))
    starts = words.shingle_starts(width)
    run = np.searchsorted(words.first, starts, side="right") - 1
    key, owner = shingle_hashes(words.hashes(), width)[starts], doc[run]
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    opens = np.concatenate([[True], key[1:] != key[:-1]])
    head = np.flatnonzero(opens)[np.cumsum(opens) - 1]
    later = np.flatnonzero(owner > owner[head])
    text, at = words.data.tobytes(), words.start
    lo, hi = at[starts[order]], at[starts[order] + width]
    same = np.fromiter((text[a:b] == text[c:d] for a, b, c, d in zip(lo[later].tolist(), hi[later].tolist(), lo[head[later]].tolist(), hi[head[later]].tolist(), strict=True)), bool, len(later))
    repeated = np.zeros(len(starts), bool)
    repeated[order[later[same]]] = True
    for i in later[~same].tolist():  # two word sequences under one hash: look for an equal one with a smaller doc_id
        group = range(int(head[i]), i)
        repeated[order[i]] = any(owner[j] < owner[i] and text[lo[j] : hi[j]] == text[lo[i] : hi[i]] for j in group)
    hits = np.flatnonzero(repeated)
    if not len(hits):
        return doc[:0], version[:0], first[:0], first[:0]
    opens = np.concatenate([[True], (np.diff(hits) != 1) | (run[hits[1:]] != run[hits[:-1]])])
    begin = hits[opens]
    last = hits[np.concatenate([np.flatnonzero(opens)[1:] - 1, [len(hits) - 1]])]
    r = run[begin]
    base = first[r] - words.first[r]
    return doc[r], version[r], base + starts[begin], base + starts[last] + width


def removed_words(docs: DataFrame, width: int = 13, minimiser: int = 3, slice_bytes: int = SLICE_BYTES, group_bytes: int = SLICE_BYTES, buckets_per_partition: int = 8) -> DataFrame:
    """doc_id, version, first, end: runs of words that a smaller doc_id also has.

    ``version`` is a hash of the text that tells rows of one doc_id apart.
    ``docs`` has doc_id, text and version.
    """
    partitions = shuffle_partitions(docs.sparkSession)
    buckets = buckets_per_partition * partitions

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, max_bytes=slice_bytes):
                if (out := runs_of(part, width, minimiser, buckets)) is not None:
                    yield out

    def to_batch(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, kinds, strict=True)], ["doc_id", "version", "first", "end"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        held_bytes, bucket = 0, None
        for batch in batches:
            cols = {n: batch.column(n) for n in NAMES}
            for i in range(batch.num_rows):
                row = {n: cols[n][i].as_py() for n in ("bucket", "settled", "runs", "packed_bytes")} | {n: cols[n][i].as_buffer() for n in ("places", "packed")}
                if row["settled"]:
                    yield to_batch(tuple(read_places(row["places"], row["runs"], 3)))
                    continue
                if held and row["bucket"] != bucket and held_bytes >= group_bytes:
                    yield to_batch(repeats_in(held, width))
                    held, held_bytes = [], 0
                bucket = row["bucket"]
                held.append(row)
                held_bytes += row["packed_bytes"]
        if held:
            yield to_batch(repeats_in(held, width))

    runs = docs.select("doc_id", "text", "version").mapInArrow(split, RUNS)
    return runs.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(count, REMOVED)


def remove_repeats(docs: DataFrame, width: int = 13, minimiser: int = 3, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text of every row."""
    kept_fields = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("version", F.hash("text"))
    removed = removed_words(docs, width, minimiser).groupBy("doc_id", "version").agg(F.collect_list(F.struct("first", "end")).alias("removed"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch):
                words = Words(*raw(part.column("text")))
                change = np.zeros(words.count + 1, np.int64)
                spans = part.column("removed")
                if spans.null_count < len(spans):
                    flat, sizes = spans.flatten(), np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                    base = np.repeat(words.first[:-1], sizes)
                    np.add.at(change, base + flat.field("first").to_numpy(), 1)
                    np.add.at(change, base + flat.field("end").to_numpy(), -1)
                kept = np.cumsum(change[:-1]) == 0
                mask = np.repeat(kept, words.lens + 1)
                data, ends = words.data[mask].tobytes(), np.concatenate([[0], np.cumsum(np.where(kept, words.lens + 1, 0))])[words.first].tolist()
                texts = [data[a : b - 1] if b > a else b"" for a, b in zip(ends[:-1], ends[1:], strict=True)]
                n = np.diff(words.first)
                cols = [part.column("doc_id"), pa.array(n), pa.array(n - counts_of(words.first, kept.astype(np.int64))), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                if with_text:
                    cols.append(pa.array([t.decode() for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in kept_fields.split(", ")])

    joined = docs.join(removed.hint("shuffle_hash"), ["doc_id", "version"], "left")
    return joined.select("doc_id", "text", "removed").mapInArrow(keep, kept_fields)
