"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a chunk wherever it is one less
than a multiple of the block size; each chunk becomes one of 64 signs, so an edit
changes the signs near it alone. A fingerprint is ``size:signs:signs`` with the
signs at the block size and at its double. Two fingerprints are compared at the
block sizes they share, by the edit distance (insertions and deletions) of the
signs; without four signs in a row in common (fewer, if there are under 12)
their likeness is 0.

Block sizes are 3 * 2^k, chosen so that a text gives about 32 to 96 chunks;
every byte counts, however long the text.

The edited-copy report pairs each document with the next in descending order of
doc_id (after the last comes the first) without gathering them in one task: the
ids are cut into ranges at quantiles, each range is sorted and streamed, and the
first document of a range is also sent to the end of the range before it.

Defined results: null text counts as empty, whose fingerprint is ``3::``; a null
doc_id sorts after all others; rows of one doc_id follow in order of their text;
a single document is its own next. Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm._session import shuffle_partitions
from tripleloom.llm._text import _WEIGHTS, mix

WINDOW = 7
SIGNS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
FEWEST, MOST = 32, 96
#: Bytes worked on at once.
BLOCK = 1 << 22

_FACTORS = _WEIGHTS[:WINDOW].astype(np.uint32) | np.uint32(1)


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, a hash of it and the six before it (zeros before the start)."""
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)])
    n = len(data)
    h = np.zeros(n, np.uint32)
    for k in range(WINDOW):
        h += padded[k : k + n] * _FACTORS[k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


def blocks(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first position, rolling hash from there on) by blocks."""
    for lo in range(0, len(data), BLOCK):
        back = min(lo, WINDOW - 1)
        yield lo, rolling(data[lo - back : lo + BLOCK])[back:]


def triggers(hashes: list[tuple[int, np.ndarray]], size: int) -> np.ndarray:
    """Positions after which a chunk ends."""
    found = [np.flatnonzero(h % np.uint32(size) == np.uint32(size - 1)) + lo + 1 for lo, h in hashes]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def signs(data: np.ndarray, ends: np.ndarray) -> str:
    """One sign for each chunk."""
    n = len(data)
    if not n:
        return ""
    starts = np.concatenate([[0], ends[ends < n]])
    sums = np.zeros(len(starts), np.uint64)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        a, b = int(np.searchsorted(starts, lo, side="right")) - 1, int(np.searchsorted(starts, hi))
        inside = np.maximum(starts[a:b], lo)
        lens = np.diff(np.append(inside, hi))
        place = np.arange(lo, hi) - np.repeat(starts[a:b], lens)
        terms = (data[lo:hi].astype(np.uint64) + np.uint64(1)) * _WEIGHTS[place & 0xFFFF]
        sums[a:b] += np.add.reduceat(terms, inside - lo)
    return SIGNS[(mix(sums) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(data: bytes) -> str:
    """The fingerprint of a text's bytes."""
    array = np.frombuffer(data, np.uint8)
    n = len(array)
    hashes = list(blocks(array)) if n <= 16 * BLOCK else None

    def ends_at(size: int) -> np.ndarray:
        return triggers(hashes if hashes is not None else blocks(array), size)

    size = 3
    while size * 64 < n:
        size *= 2
    ends = ends_at(size)
    if len(ends) > MOST:
        while len(ends) > MOST:
            size *= 2
            ends = ends_at(size)
    else:
        while len(ends) < FEWEST and size > 3:
            more = ends_at(size // 2)
            if len(more) > MOST:
                break
            size, ends = size // 2, more
    return f"{size}:{signs(array, ends)}:{signs(array, ends_at(2 * size))}"


def squeezed(text: str) -> str:
    """Runs of one sign cut to three: they say little."""
    if len(text) < 4:
        return text
    a = np.frombuffer(text.encode(), np.uint8)
    again = np.concatenate([[False, False, False], (a[3:] == a[2:-1]) & (a[3:] == a[1:-2]) & (a[3:] == a[:-3])])
    return a[~again].tobytes().decode()


def sign_likeness(a: str, b: str, in_common: int = 4) -> float:
    """1 - edit distance / total length, 0 without a common run of signs."""
    a, b = squeezed(a), squeezed(b)
    if a == b:
        return 1.0
    k = min(in_common, len(a), len(b), 1 + min(len(a), len(b)) // 4)
    if not k or {a[i : i + k] for i in range(len(a) - k + 1)}.isdisjoint(b[i : i + k] for i in range(len(b) - k + 1)):
        return 0.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full  # bit-parallel longest common subsequence: its zeros count matches
    for c in b:
        u = row & where.get(c, 0)
        row = ((row + u) | (row - u)) & full
    common = len(a) - row.bit_count()
    return 2.0 * common / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """Likeness of two fingerprints, 0 to 1; 0 at incompatible block sizes."""
    if x == y:
        return 1.0
    xs, x1, x2 = x.split(":")
    ys, y1, y2 = y.split(":")
    if xs == ys:
        return max(sign_likeness(x1, y1), sign_likeness(x2, y2) if x2 and y2 else 0.0)
    if int(xs) == 2 * int(ys):
        return sign_likeness(x1, y2)
    if int(ys) == 2 * int(xs):
        return sign_likeness(x2, y1)
    return 0.0


def fingerprint_texts(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def with_successor(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, text, place, guest: sorted so that each row's successor in descending doc_id follows it.

    ``place`` numbers the ranges; rows with ``guest`` only serve as the successor
    of a range's last row. ``ranges`` is four a shuffle partition by default: the
    driver holds one number of each.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rank = F.coalesce("doc_id", F.lit(-(1 << 63)))
    ranges = ranges or 4 * shuffle_partitions(spark)
    cuts = docs.agg(F.percentile_approx(rank, [(i + 1) / ranges for i in range(ranges - 1)] or [0.5], 10 * ranges)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    wide = 64
    above = lambda column: F.size(F.filter(column, lambda x: x > rank))
    place = F.lit(0)
    if cuts:
        group = above(F.lit(cuts[wide - 1 :: wide]) if len(cuts) >= wide else F.array().cast("array<long>"))
        tables = [cuts[i : i + wide] for i in range(0, len(cuts), wide)] + [[]]
        place = group * wide + above(F.element_at(F.array(*[F.lit(t) if t else F.array().cast("array<long>") for t in tables]), group + 1))
    placed = docs.withColumn("place", place.cast("int"))
    heads = sorted((r.place, r.head) for r in placed.groupBy("place").agg(F.max(rank).alias("head")).collect())
    if not heads:
        return docs.select("doc_id", "text", F.lit(0).alias("place"), F.lit(False).alias("guest"))
    before = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]  # the first one's guest goes to the last range
    guests = spark.createDataFrame(before, "head long, host int")
    both = placed.join(F.broadcast(guests), F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("head"), "left")
    homes = F.when(F.col("host").isNull(), F.array(F.struct(F.col("place"), F.lit(False).alias("guest")))).otherwise(F.array(F.struct(F.col("place"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("place"), F.lit(True).alias("guest"))))
    spread = both.select("doc_id", "text", F.explode(homes).alias("home")).select("doc_id", "text", "home.place", "home.guest")
    return spread.repartition("place").sortWithinPartitions("place", "guest", F.col("doc_id").desc_nulls_last(), "text")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_copies(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit, and their likeness.

    The edit replaces the last half of a text by the start of the next document.
    """

    def finish(doc: tuple, text: str, sign: str, next_text: str, next_sign: str) -> tuple:
        n = len(text)
        edited = (text[: n - n // 2] + next_text[: n // 2]).encode()
        edited_sign = fingerprint(edited)
        return doc, n, hashlib.sha256(edited).hexdigest(), sign, edited_sign, likeness(sign, edited_sign), likeness(sign, next_sign)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = []
            for doc, text, place, guest in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if guest and (held is None or held[2] != place):
                    continue
                sign = fingerprint(text.encode())
                if held is not None:
                    rows.append(finish(held[0], held[1], held[3], text, sign))
                held = None if guest else (doc, text, place, sign)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], [x.split()[0] for x in EDITED.split(", ")])

    return with_successor(docs).mapInArrow(run, EDITED)
