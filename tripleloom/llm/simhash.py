"""SimHash near-duplicates by generalised pigeonhole search.

Each text gets a 64-bit fingerprint. Distinct fingerprints are then searched for
pairs within ``radius`` bits. The 64 bits are grouped into parts, correlated bits
together, and each part gets its own threshold t >= -1 with
sum(t) = radius - parts + 1: by the generalised pigeonhole principle a pair
within the radius is within the threshold on some part. Grouping and correlation
come from a bounded sample of fingerprints; the number of parts and the
thresholds minimise the estimated number of probes and candidates by dynamic
programming. A wrong estimate costs time, never a link.

Each fingerprint is indexed under its own bits of a part and probed under all
values within the threshold; every candidate is verified on all 64 bits. A
bucket with more than ``block`` rows is split into blocks that meet in pairs, so
no task holds an unbounded bucket, and tasks return stars of what they have linked
only, never all pairs of a group. Connected components follow by star contraction,
which stars leave little to do for.

Defined results: null or empty text has fingerprint zero and links like any
other; equal fingerprints are always linked; repeated rows are answered each; a
null doc_id is never a component's id unless it is alone. Extra columns are
ignored; an empty table gives no rows.

``one_of_each`` probes by the same search over fingerprints of shingle sets and
decides by the sets' exact likeness: texts whose fingerprints connect within
``NEAR`` bits are compared whole. Fingerprints of likeness 0.8 differ by about ten
bits, so no radius that unrelated texts do not connect at holds all such pairs;
what lies beyond the radius is proposed by MinHash keys, and decided the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm._session import durable, join_counted
from tripleloom.llm._text import SLICE_BYTES, Words, raw, row_slices
from tripleloom.llm.likeness import BANDS, LOWER, alike, set_fingerprints, slice_keys, slice_sets


def slice_fingerprints(texts: pa.Array, k: int, seed: int) -> np.ndarray:
    """Fingerprint of each text of a slice, as uint64."""
    data, offsets = raw(texts)
    words = Words(LOWER[data], offsets)
    n = np.diff(words.first)
    starts = words.shingle_starts(k)
    few = (n > 0) & (n < k)
    begin = np.concatenate([starts, words.first[:-1][few]])
    end = np.concatenate([starts + k, words.first[1:][few]])
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], end[order]
    text, digest = words.data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], seed) for a, b in zip(words.start[begin].tolist(), (words.start[end] - 1).tolist(), strict=True)), np.uint64, len(begin))
    first = np.searchsorted(begin, words.first)
    out = np.zeros(len(texts), np.uint64)
    for d in np.flatnonzero(np.diff(first)):
        own = hashes[first[d] : first[d + 1]]
        ones = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[d] = np.packbits(2 * ones > len(own), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, max_bytes=SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(slice_fingerprints(part.column("text"), k, seed).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_parts(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Split 64 bits into parts of near-equal width, correlated bits together."""
    x = bits - bits.mean(axis=0)
    norm = np.sqrt((x * x).sum(axis=0)) + 1e-9
    corr = np.abs(x.T @ x) / np.outer(norm, norm)
    np.fill_diagonal(corr, 0)
    left, out = set(range(64)), []
    for p in range(parts):
        width = 64 // parts + (p < 64 % parts)
        pool = sorted(left)
        group = [pool[int(np.argmax(corr[np.ix_(pool, pool)].sum(axis=1)))]]
        left.discard(group[0])
        while len(group) < width:
            pool = sorted(left)
            group.append(pool[int(np.argmax(corr[np.ix_(group, pool)].sum(axis=0)))])
            left.discard(group[-1])
        out.append(sorted(group))
    return out


def variants(width: int, threshold: int) -> int:
    return sum(comb(width, j) for j in range(threshold + 1))


def plan_search(sample: np.ndarray, n: int, radius: int, row_cost: float = 500.0, max_variants: int = 2000) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part with the least estimated cost for n fingerprints.

    Costs are in candidate comparisons; one probe row costs ``row_cost`` of them.
    """
    bits = bits_of(sample) if len(sample) else np.zeros((1, 64), np.uint8)
    half = len(bits) // 2
    best, best_cost = [], float("inf")
    for m in range(1, radius + 2):
        groups = correlated_parts(bits.astype(float), m)
        total = radius - m + 1
        # state: thresholds plus one, summed; -1 skips a part
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            w = len(group)
            a, b = bits[:half][:, group].astype(np.float32), bits[half : 2 * half][:, group].astype(np.float32)
            apart = (a @ (1 - b).T + (1 - a) @ b.T) if half else np.zeros((0, 0))
            nxt: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in table.items():
                for t in range(-1, total + m - used):
                    if t > w or variants(w, t) > max_variants:
                        break
                    v = variants(w, t)
                    share = max(float((apart <= t + 0.5).mean()) if apart.size else 0.0, v / 2.0**w) if t >= 0 else 0.0
                    c = cost + (n * (v + (t > 0)) * row_cost + share * n * n / (1 if t else 2) if t >= 0 else 0.0)
                    if used + t + 1 not in nxt or c < nxt[used + t + 1][0]:
                        nxt[used + t + 1] = (c, [*chosen, t])
            table = nxt
        if total + m in table and table[total + m][0] < best_cost:
            best_cost, thresholds = table[total + m]
            best = list(zip(groups, thresholds, strict=True))
    return best


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def probes_of(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, bool, bool]]:
    """(part, mask of its bits, bits to flip, is an index row, is a probe)."""
    out = []
    for p, (bits, t) in enumerate(plan):
        mask = signed(sum(1 << b for b in bits))
        if t == 0:
            out.append((p, mask, 0, True, True))
        elif t > 0:
            out.append((p, mask, 0, True, False))
            out += [(p, mask, signed(sum(1 << b for b in flip)), False, True) for j in range(t + 1) for flip in combinations(bits, j)]
    return out


class Forest:
    """Union-find that says whether a link joins two trees; the root is a tree's least node."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def stars(self) -> list[tuple[int, int]]:
        """(node, root) of every node that is no root."""
        return [(x, root) for x in list(self.parent) if (root := self.find(x)) != x]


def spanning_links(cells: np.ndarray, fp: np.ndarray, index: np.ndarray, probe: np.ndarray, radius: int, most: int = 1 << 22) -> list[tuple[int, int]]:
    """(fp, least fp connected with it) over links within ``radius`` inside each run of equal ``cells``."""
    forest = Forest()

    def verify(i: np.ndarray, j: np.ndarray) -> None:
        a, b = fp[i], fp[j]
        near = (a != b) & (np.bitwise_count((a ^ b).view(np.uint64)) <= radius)
        i, j = i[near], j[near]
        while len(i):
            # one pair of each run is joined, then those that close cycles go: a dense group takes few rounds
            runs = np.flatnonzero(np.diff(i, prepend=-1))
            for x, y in zip(fp[i[runs]].tolist(), fp[j[runs]].tolist(), strict=True):
                forest.join(x, y)
            used = np.zeros(len(fp), bool)
            used[i] = used[j] = True
            rows, tree = np.flatnonzero(used), np.zeros(len(fp), np.int64)
            tree[rows] = [forest.find(x) for x in fp[rows].tolist()]
            apart = tree[i] != tree[j]
            i, j = i[apart], j[apart]

    edge = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1], [True]]))
    left, right, size = [], [], 0
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if hi - lo < 2:
            continue
        a, b = lo + np.flatnonzero(index[lo:hi]), lo + np.flatnonzero(probe[lo:hi])
        step = max(1, most // max(1, len(b)))
        for i in range(0, len(a), step):
            some = a[i : i + step]
            if size + len(some) * len(b) > most and size:
                verify(np.concatenate(left), np.concatenate(right))
                left, right, size = [], [], 0
            left.append(np.repeat(some, len(b)))
            right.append(np.tile(b, len(some)))
            size += len(some) * len(b)
    if size:
        verify(np.concatenate(left), np.concatenate(right))
    return forest.stars()


def links(fps: DataFrame, radius: int, sample_rows: int = 2048, block: int = 4096) -> DataFrame:
    """Links (a, b) that connect every two distinct fingerprints within ``radius`` bits.

    ``fps`` has one row for each distinct fp. ``sample_rows`` bounds the sample
    from which the search is planned.
    """
    spark = fps.sparkSession
    sample = np.array([r[0] for r in fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).collect()], np.int64)
    plan = plan_search(sample, fps.count(), radius)
    rows = probes_of(plan)
    table = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(m).alias("mask"), F.lit(x).alias("flip"), F.lit(i).alias("is_index"), F.lit(q).alias("is_probe")) for p, m, x, i, q in rows])
    cells = fps.select("fp", F.explode(table).alias("t")).select("fp", "t.part", F.col("fp").bitwiseAND(F.col("t.mask")).bitwiseXOR(F.col("t.flip")).alias("key"), "t.is_index", "t.is_probe")
    hot = cells.groupBy("part", "key").count().where(F.col("count") > block).select("part", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    own, other = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = cells.join(hot, ["part", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    both = cells.where("blocks = 1").withColumn("cell", F.lit(0))
    split = cells.where("blocks > 1")
    as_index = split.where("is_index").withColumn("other", other).withColumn("cell", own * F.col("blocks") + F.col("other")).withColumn("is_probe", F.lit(False)).drop("other")
    as_probe = split.where("is_probe").withColumn("other", other).withColumn("cell", F.col("other") * F.col("blocks") + own).withColumn("is_index", F.lit(False)).drop("other")
    keyed = both.unionByName(as_index).unionByName(as_probe).select(F.xxhash64("part", "key", "cell").alias("cell"), "fp", "is_index", "is_probe")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], []]

        def flush(upto: int | None) -> list[tuple[int, int]]:
            whole = [np.concatenate(x) for x in held]
            cut = len(whole[0]) if upto is None else int(np.searchsorted(whole[0], whole[0][-1]))
            for k in range(4):
                held[k] = [whole[k][cut:]]
            return spanning_links(*[x[:cut] for x in whole], radius) if cut else []

        for batch in batches:
            if batch.num_rows:
                for k in range(4):
                    held[k].append(batch.column(k).to_numpy(zero_copy_only=False))
                yield pairs(flush(1))
        if held[0]:
            yield pairs(flush(None))

    def pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], ["a", "b"])

    return keyed.repartition("cell").sortWithinPartitions("cell").mapInArrow(search, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node reachable over edges (a, b), by star contraction; the rows of a hub stay dealt.

    Done as soon as every node has one smaller neighbour at most and that has none,
    which the degrees of a round's start tell: edges that are stars take no round.
    """
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())  # a > b from here on
    while True:
        sides = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
        least = durable(sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("b") < F.col("a")).alias("up")))
        ends, unsettled = least.agg(F.sum("n"), F.count_if(F.expr("up > 1 OR up > 0 AND n > up"))).first()
        if not unsettled:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        # large star: every larger neighbour links to the least of the neighbourhood
        edges = durable(join_counted(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), least.drop("up"), "a", ends).select(F.col("b").alias("a"), F.col("m").alias("b")))
        # small star: every smaller neighbour and the node itself link to the least of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        edges = durable(join_counted(edges, least, "a", ends).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    fps = durable(fingerprints(docs, k, seed))
    distinct = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")))
    sizes = distinct.agg(F.count(F.lit(1)), F.sum("n")).first()
    roots = components(links(distinct, radius))
    joined = durable(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_doc", F.col("n").alias("rows"), F.coalesce("root", "fp").alias("root")))
    groups = joined.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = durable(join_counted(joined.select("fp", "rows", "root"), groups, "root", sizes[0]).select("fp", "component_id", F.col("rows").alias("n")))
    found = join_counted(fps, named, "fp", sizes[1] or 0)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Stands for a null doc_id, after all others.
LAST = (1 << 63) - 1

#: Bits within which fingerprints of sets connect: five parts of the search with one bit each; of 10 million random
#: fingerprints, one has 0.02 others so near.
NEAR = 9


def text_classes(docs: DataFrame, k: int) -> DataFrame:
    """owner, version, doc_id, cls, size, fp and keys of every row; equal shingle sets have one class, short texts no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, max_bytes=SLICE_BYTES):
                hashes, first, classes = slice_sets(part.column("text"), k)
                ends = np.concatenate([[0], np.cumsum(np.diff(first) > 0)]) * BANDS
                keys = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(slice_keys(hashes, first).view(np.int64).ravel()))
                found = [classes.view(np.int64), np.diff(first).astype(np.int64), set_fingerprints(hashes, first).view(np.int64)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("owner", "version", "doc_id")), *map(pa.array, found), keys], ["owner", "version", "doc_id", "cls", "size", "fp", "keys"])

    return keyed_texts(docs).mapInArrow(run, "owner long, version long, doc_id long, cls long, size long, fp long, keys array<long>")


def keyed_texts(docs: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.coalesce(doc_id, F.lit(LAST)).alias("owner"), F.xxhash64(text).alias("version"), doc_id.alias("doc_id"), text.alias("text"))


def near_fingerprints(classes: DataFrame, threshold: float, radius: int = NEAR) -> DataFrame:
    """cls, key: classes whose fingerprints connect within ``radius`` bits have one key, by the search of ``links``.

    A set of n elements is at most n / (n + 1) like a different one; those that
    can't be like any are left out.
    """
    some = classes.where(F.col("size") >= threshold * (F.col("size") + 1) - 1e-9).select("cls", "fp")
    roots = components(links(durable(some.select("fp").distinct()), radius))
    return some.join(roots, some.fp == roots.node, "left").select("cls", F.xxhash64(F.lit("near"), F.coalesce("root", "fp")).alias("key"))


def likeness_links(docs: DataFrame, classes: DataFrame, k: int, threshold: float, block: int = 256) -> DataFrame:
    """Links (a, b) that connect every two classes of a likeness of ``threshold`` or more that are probed together.

    Probed are classes whose fingerprints are near, and beyond that those that
    share a MinHash key. ``classes`` has one row for each cls. Texts that meet under several keys in
    the same company are compared once; more than ``block`` under one key are
    split into blocks that meet in pairs.
    """
    keyed = near_fingerprints(classes, threshold).unionByName(classes.select("cls", F.explode("keys").alias("key")))
    company = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("y")).where("n > 1")
    company = company.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    members = durable(keyed.join(company, "key").select("key", "cls", "blocks"))
    needed = classes.join(members.select("cls").distinct(), "cls", "left_semi").select("owner", "version")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, max_bytes=SLICE_BYTES):
                hashes, first, found = slice_sets(part.column("text"), k)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(8 * first.astype(np.int64)), pa.py_buffer(hashes)]).cast(pa.binary())], ["cls", "hashes"])

    own, other = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = members.select("*", own.alias("own"), other.alias("other")).select("cls", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
    whole = keyed_texts(docs).join(needed, ["owner", "version"], "left_semi").select("text").mapInArrow(sets, "cls long, hashes binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}

        def linked() -> pa.RecordBatch:
            trees = []
            for a in sorted(held):
                whole, apart = [a], []
                for tree in trees:  # one link to each tree is enough
                    if any(alike(held[a], held[b], threshold) for b in tree):
                        whole += tree
                    else:
                        apart.append(tree)
                trees = [*apart, whole]
            found = [(least, x) for tree in trees for least in [min(tree)] for x in tree if x != least]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for at, cls, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if at != cell:
                    if len(held) > 1:
                        yield linked()
                    cell, held = at, {}
                held[cls] = np.frombuffer(hashes.as_buffer(), np.uint64).copy()
        if len(held) > 1:
            yield linked()

    return cells.join(whole, "cls").select("cell", "cls", "hashes").repartition("cell").sortWithinPartitions("cell").mapInArrow(search, "a long, b long").distinct()


def one_of_each(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its near-duplicates, unchanged.

    Near-duplicates are connected by pairs whose ``k``-word shingle sets have a
    likeness of ``threshold`` or more; texts of fewer words must have the same words.
    Rows that repeat a doc_id are one document and stay or go together; rows without
    one come after all others and are told apart by their text.
    """
    rows = text_classes(docs, k)
    classes = durable(rows.groupBy("cls").agg(F.min("doc_id").alias("first_doc"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.min(F.struct("owner", "version", "keys")).alias("one")).select("cls", "first_doc", "size", "fp", "one.*"))
    roots = components(likeness_links(docs, classes, k, threshold))
    joined = classes.join(roots, classes.cls == roots.node, "left").select("owner", "version", F.coalesce("root", "cls").alias("root"))
    # the row that stays: told by its doc_id, or without one by its text
    version = F.when(F.col("one.owner") == LAST, F.col("one.version")).otherwise(0)
    kept = joined.groupBy("root").agg(F.min(F.struct("owner", "version")).alias("one")).select(F.col("one.owner").alias("_owner"), version.alias("_version")).distinct()
    owner = F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST))
    own_version = F.when(docs["doc_id"].isNull(), F.xxhash64(docs["text"].cast("string"))).otherwise(0)
    return docs.join(kept, (owner == kept["_owner"]) & (own_version == kept["_version"]), "left_semi")
