"""Language identification of mixed-language text.

A word is a run of letters and the marks on them. It scores under each language
by its letter n-grams (two to four bytes, with the word's edges), learned as
counts over labelled documents. The script of a word, told by the range of its
first letter's code point, narrows its candidates to languages written in that
script. The best sequence of languages over a text's words, with
a penalty for every switch, labels its spans (Viterbi); a text's language is the
one with most letters.

Counts are learned from a sample of at most about ``max_train`` labelled
documents drawn by a hash of doc_id, an equal number of each language as far as
there are so many, so that rare languages are learned at every size; every text
is labelled whole.

Defined results: null text, or text without letters, is ``und`` with score 0 and
no spans; digits, punctuation and lone dashes are no words; ties go to the
language first in order; repeated rows are answered
each; a null doc_id is not held out and not learned from. Without any labelled
document every text is ``und``. Extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm._text import _WEIGHTS, Words, counts_of, mix, raw, row_slices

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BUCKETS = 1 << 17
UNKNOWN = "und"

#: Scripts by ranges of code points; a letter outside all of them is of an ``other`` script.
RANGES = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x2AF), (0x1D00, 0x1D25), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA722, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x531, 0x58F), (0xFB13, 0xFB17)),
    "hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x870, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE)),
    "indic": ((0x900, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF), (0xFFA0, 0xFFDC)),
    "kana": ((0x3041, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)),
    "han": ((0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}
SCRIPTS = (*RANGES, "other")
#: Code points above are no letters.
TABLE_END = 0x323B0


@lru_cache(maxsize=1)
def code_points() -> tuple[np.ndarray, np.ndarray]:
    """(0 no letter, 1 mark, 2 letter; script) of each code point under ``TABLE_END``."""
    kind = np.fromiter(({"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(TABLE_END)), np.uint8, TABLE_END)
    script = np.full(TABLE_END, SCRIPTS.index("other"), np.int8)
    for name, ranges in RANGES.items():
        for lo, hi in ranges:
            script[lo : hi + 1] = SCRIPTS.index(name)
    return kind, script


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # [bucket, language] log shares, less their mean
    scripts: np.ndarray  # [script, language] whether the language is written so


def decoded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each code point, code point) of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    size = np.ones(len(at), np.int8)
    for least in (0xC0, 0xE0, 0xF0):
        size += lead >= least
    point = np.where(size == 1, lead, lead & (0x7F >> size))
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        point[more] = point[more] << 6 | (data[at[more] + k] & 0x3F)
    return at, point


def letter_words(texts: pa.Array) -> Words:
    """Runs of letters and the marks on them, A-Z in lower case; with ``letters``, the letters of each word."""
    data, offsets = raw(texts)
    kind = code_points()[0]
    if not len(data) or data.max() < 128:
        of_byte = kind[data]
        letter = of_byte == 2
    else:
        at, point = decoded(data)
        of_point = np.where(point < TABLE_END, kind[np.minimum(point, TABLE_END - 1)], 0)
        of_byte = np.repeat(of_point, np.diff(np.append(at, len(data))))
        letter = np.zeros(len(data), bool)
        letter[at] = of_point == 2
    words = Words(LOWER[data], offsets, sep=0, inside=of_byte > 0)
    total = np.concatenate([[0], np.cumsum(letter[of_byte > 0])])
    words.letters = np.diff(total[words.compact_start])
    return words


class Distinct:
    """The distinct words of a slice with their n-grams and scripts."""

    def __init__(self, words: Words):
        coded = words.strings().dictionary_encode()
        self.codes = coded.indices.to_numpy().astype(np.int64)
        data, offsets = raw(coded.dictionary.cast(pa.binary()))
        self.count = len(coded.dictionary)
        lens = np.diff(offsets)
        edged = np.full(len(data) + 2 * self.count, 0x20, np.uint8)
        at = offsets[:-1] + 2 * np.arange(self.count)
        edged[np.arange(len(data)) + np.repeat(2 * np.arange(self.count) + 1, lens)] = data
        ends = at + lens + 2
        owner = np.repeat(np.arange(self.count), lens + 2)
        room = np.repeat(ends, lens + 2) - np.arange(len(edged))
        wide = edged.astype(np.uint64)
        grams, owners = [], []
        total = np.zeros(len(edged), np.uint64)
        for n in range(4):
            total[: len(edged) - n] += (wide[n:] + np.uint64(1)) * _WEIGHTS[n]
            if n:
                fits = np.flatnonzero(room > n)
                grams.append((mix(total[fits] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
                owners.append(owner[fits])
        self.grams, self.owners = np.concatenate(grams), np.concatenate(owners)
        kind, script = code_points()
        at, point = decoded(data)
        # the script of a word is its first letter's; marks alone have no letter
        point = np.minimum(point, TABLE_END - 1)
        of_word = np.searchsorted(offsets, at, side="right") - 1
        letter = np.flatnonzero(kind[point] == 2)
        with_letter, place = np.unique(of_word[letter], return_index=True)
        self.scripts = np.full(self.count, SCRIPTS.index("other"))
        self.scripts[with_letter] = script[point[letter[place]]]


def count_grams(docs: DataFrame, languages: list[str]) -> DataFrame:
    """kind (gram or script), key, language number, n over labelled documents (text, lang)."""
    number = {x: i for i, x in enumerate(languages)}
    size = len(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, scripts = np.zeros((size, BUCKETS)), np.zeros((size, len(SCRIPTS)))
        for batch in batches:
            for part in row_slices(batch):
                words = letter_words(part.column("text"))
                if not words.count:
                    continue
                seen = Distinct(words)
                lang = np.array([number[x] for x in part.column("lang").to_pylist()])
                of_word = np.repeat(lang, np.diff(words.first))
                times = np.bincount(seen.codes * size + of_word, minlength=seen.count * size).reshape(-1, size)
                for k in np.unique(lang).tolist():
                    grams[k] += np.bincount(seen.grams, times[seen.owners, k], BUCKETS)
                    scripts[k] += np.bincount(seen.scripts, times[:, k], len(SCRIPTS))
        for kind, table in enumerate((grams, scripts)):
            k, key = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind), pa.int32()), pa.array(key, pa.int64()), pa.array(k, pa.int32()), pa.array(table[k, key].astype(np.int64))], ["kind", "key", "lang", "n"])

    counts = docs.select("text", "lang").mapInArrow(run, "kind int, key long, lang int, n long")
    return counts.groupBy("kind", "key", "lang").agg(F.sum("n").alias("n"))


def shares(known: dict[str, int], budget: int) -> dict[str, float]:
    """Share of each language's rows to draw: equal budgets, what a rare language leaves goes to the others."""
    out, left = {}, budget
    for k, (name, n) in enumerate(sorted(known.items(), key=lambda x: (x[1], x[0]))):
        take = min(n, left / (len(known) - k))
        out[name] = take / n
        left -= take
    return out


def train(docs: DataFrame, learn, max_train: int = 40_000, min_share: float = 0.005, smooth: float = 0.5) -> Model:
    """Learn from rows of ``docs`` for which ``learn`` holds and lang is known."""
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    known = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(known)
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(int(v * (1 << 40)))) for x, v in shares(known, max_train).items()], F.lit(0))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < share)
    size = len(languages)
    grams, scripts = np.zeros((BUCKETS, size)), np.zeros((len(SCRIPTS), size))
    if size:
        found = count_grams(sample, languages).toArrow()  # at most buckets times languages
        kind, key, lang, n = (found.column(c).to_numpy() for c in ("kind", "key", "lang", "n"))
        grams[key[kind == 0], lang[kind == 0]] = n[kind == 0]
        scripts[key[kind == 1], lang[kind == 1]] = n[kind == 1]
    logs = np.log((grams + smooth) / (grams.sum(axis=0) + smooth * BUCKETS))
    logs -= logs.mean(axis=1, keepdims=True) if size else 0
    return Model(languages, logs.astype(np.float32), scripts >= min_share * np.maximum(scripts.sum(axis=0), 1))


def word_scores(model: Model, words: Words, most: float = 6.0) -> np.ndarray:
    """Score of each word under each language, at most ``most`` apart."""
    seen = Distinct(words)
    size = len(model.languages)
    total = np.stack([np.bincount(seen.owners, model.grams[seen.grams, k], seen.count) for k in range(size)], axis=1) / 3.0
    allowed = model.scripts[seen.scripts]
    total = np.where(allowed | ~allowed.any(axis=1, keepdims=True), total, -1e9)
    total = np.maximum(total - total.max(axis=1, keepdims=True, initial=-1e9), -most)
    total[~allowed.any(axis=1)] = 0.0
    return total[seen.codes]


def best_paths(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Language number of each word on the best path through each text."""
    out = np.zeros(len(scores), np.int8)
    hard: list[int] = []
    for d in range(len(first) - 1):
        lo, hi = int(first[d]), int(first[d + 1])
        if lo == hi:
            continue
        own = scores[lo:hi]
        best = int(np.argmax(own.sum(axis=0)))
        # r runs of other languages gain at most r times the best run of differences and cost r - 1 switches at least
        gain = np.cumsum(own - own[:, best : best + 1], axis=0)
        least = np.minimum(np.minimum.accumulate(gain, axis=0), 0.0)
        before = np.vstack([np.zeros((1, own.shape[1])), least[:-1]])
        out[lo:hi] = best
        if (gain - before).max() > penalty / 2:
            hard.append(d)
    if not hard:
        return out
    # texts side by side, the longest first, one word at a time
    lens = np.diff(first)[hard]
    order = np.argsort(-lens, kind="stable")
    starts, lens = first[:-1][np.array(hard)[order]], lens[order]
    active = np.searchsorted(-lens, -np.arange(1, int(lens[0]) + 1), side="right")
    size = scores.shape[1]
    came = np.zeros((len(scores), size), np.int8)
    value = scores[starts].copy()
    languages = np.arange(size, dtype=np.int8)
    for t in range(1, int(lens[0])):
        n = int(active[t])
        v = value[:n]
        top = v.argmax(axis=1)
        moved = v[np.arange(n), top] - penalty
        switch = moved[:, None] > v
        came[starts[:n] + t] = np.where(switch, top[:, None], languages)
        value[:n] = np.where(switch, moved[:, None], v) + scores[starts[:n] + t]
    state = value.argmax(axis=1)
    for t in range(int(lens[0]) - 1, -1, -1):
        n = int(active[t])
        at = starts[:n] + t
        out[at] = state[:n]
        state[:n] = came[at, state[:n]] if t else state[:n]
    return out


LABELS = "doc_id long, lang_pred string, score double, spans array<struct<first_word:int,words:int,lang:string>>"


def label(docs: DataFrame, model: Model, penalty: float = 12.0) -> DataFrame:
    """doc_id, lang_pred, score (share of letters in that language) and spans of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets times languages
    span = pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in row_slices(batch):
                words = letter_words(part.column("text"))
                first, n = words.first, part.num_rows
                if not model.languages or not words.count:
                    empty = pa.array([[]] * n, pa.list_(span))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([UNKNOWN] * n), pa.array(np.zeros(n)), empty], ["doc_id", "lang_pred", "score", "spans"])
                    continue
                path = best_paths(word_scores(model, words), first, penalty)
                letters = np.stack([counts_of(first, np.where(path == k, words.letters, 0)) for k in range(len(model.languages))], axis=1)
                total = letters.sum(axis=1)
                top = letters.argmax(axis=1)
                real = total > 0
                opens = np.zeros(words.count, bool)
                opens[first[:-1][np.diff(first) > 0]] = True
                opens[1:] |= path[1:] != path[:-1]
                begin = np.flatnonzero(opens)
                owner = np.searchsorted(first, begin, side="right") - 1
                sizes = np.diff(np.append(begin, words.count))
                keep = real[owner]
                begin, owner, sizes = begin[keep], owner[keep], sizes[keep]
                names = np.array(model.languages, dtype=object)
                values = pa.StructArray.from_arrays([pa.array(begin - first[owner], pa.int32()), pa.array(sizes, pa.int32()), pa.array(names[path[begin]], pa.string())], fields=list(span))
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)
                pred = pa.array(np.where(real, names[top], UNKNOWN), pa.string())
                score = np.where(real, letters[np.arange(n), top] / np.maximum(total, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pred, pa.array(score), spans], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, LABELS)


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; held-out rows are not learned from."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = train(docs, fold != 2, **options)
    held_out = F.coalesce(fold == 2, F.lit(False))
    return label(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
