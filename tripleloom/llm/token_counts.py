"""Token counts: batch encoding in an Arrow function that returns lengths only.

Each task encodes batches of about equal bytes. A text longer than a batch is
split at safe boundaries: after white space, which no token crosses, or in a run
without any between an ASCII letter and a punctuation mark. Words are cut further
into parts where both neighbours are ASCII and the tokenizer's own pattern always
cuts, so that in a batch every distinct part is encoded once. A worker remembers
the parts of the last batches up to a number of bytes, so memory is bounded by the
batch and that number.

Null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each.
doc_id of any integer type is returned as long. Extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm._text import SLICE_BYTES, Words, byte_set, counts_of, raw

#: White space that every supported tokenizer file drops between words.
SAFE = byte_set(b"\t\n\r ")

#: Classes of ASCII bytes in the pattern of the tokenizer file: letters, digits, others; 0 is no ASCII.
LETTER, DIGIT, OTHER = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[:128] = OTHER
_CLASS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = LETTER
_CLASS[list(b"0123456789")] = DIGIT

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of which no word is cut: control characters may be white space to the pattern, ``|`` may belong to a special token.
_WHOLE = byte_set(bytes(range(32)) + b"\x7f|")
_QUOTE = ord("'")

#: Between such bytes even a run without white space may be cut.
_ENDS_WORD = (_CLASS == LETTER) | (_CLASS == DIGIT)
_BEGINS_MARKS = byte_set(b".,;:!?()[]{}/=&-+*_")

#: A word that stands between the words of a batch; words with this character are encoded alone.
MARK = "\x01"


@lru_cache(maxsize=2)
def word_encoder(path: str) -> "WordEncoder":
    """One encoder for each worker process and file."""
    return WordEncoder(path)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def parts_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all words, ends of their parts): what the pattern always cuts, with ASCII letters in lower case.

    A cut lies between two ASCII bytes of different classes or two digits, but
    not inside ``'s 't 'm 'd 're 've 'll`` at the start of a run of marks, after
    which there is one. A word with a control character, a ``|``, or a
    quotation mark beside a character outside ASCII stays whole and unchanged.
    """
    data, starts = words.data, words.start
    n = len(data)
    kind = _CLASS[data]
    is_start = np.zeros(n + 3, bool)
    is_start[starts] = True
    whole_at = _WHOLE[data]
    ascii_next = np.ones(n, bool)
    ascii_next[:-1] = (kind[1:] != 0) | is_start[1:n]
    lower = np.where(ascii_next, _LOWER[data], data)
    cut = np.zeros(n + 3, bool)
    a, b = kind[:-1], kind[1:]
    cut[1:n] = (a != 0) & (b != 0) & ((a != b) | (b == DIGIT))
    quotes = np.flatnonzero(data == _QUOTE)
    if len(quotes):
        near = np.zeros(n + 4, np.uint8)
        near[:n] = kind
        low = np.zeros(n + 4, np.uint8)
        low[:n] = lower
        before = np.where(is_start[quotes], LETTER, near[quotes - 1])
        # letters after the mark that belong to its word
        one = ~is_start[quotes + 1]
        two = one & ~is_start[quotes + 2]
        c, d = low[quotes + 1], low[quotes + 2]
        short = one & np.isin(c, list(b"stmd"))
        long = two & (((c == ord("r")) | (c == ord("v"))) & (d == ord("e")) | (c == ord("l")) & (d == ord("l")))
        odd = (before == 0) | one & (near[quotes + 1] == 0) | two & (near[quotes + 2] == 0) | two & ~is_start[np.minimum(quotes + 3, n)] & (near[quotes + 3] == 0)
        whole_at[quotes[odd]] = True
        joined = (short | long) & (before != OTHER) & (before != 0)
        at, size = quotes[joined], np.where(long, 3, 2)[joined]
        cut[at + 1] = False
        cut[at + size] = True
    if whole_at.any():
        whole = np.unique(np.searchsorted(starts, np.flatnonzero(whole_at), side="right") - 1)
        lens = words.lens[whole]
        inside = np.repeat(starts[whole] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        cut[inside] = False
        lower[inside] = data[inside]
    cut[starts] = True
    return lower, np.flatnonzero(cut[: n + 1])


class WordEncoder:
    """Encodes words with a tokenizer whose tokens cross neither white space nor the cuts of ``parts_of``.

    It remembers parts in two generations of up to ``max_known`` bytes each; a
    part used again moves to the young one, and a full young one replaces the old.
    """

    #: Bytes that a remembered part costs beside its characters and ids.
    COST = 200

    def __init__(self, path: str, max_known: int = 48 << 20):
        self.tokenizer = load_tokenizer(path)
        self.max_known = max_known
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.used = 0
        self.mark = self._library([MARK])[0]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, np.uint32).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_all(self, words: list[str], together: int = 256) -> list[bytes]:
        """Ids of each word: many words a call, separated by the mark's single id."""
        if len(self.mark) != 4:
            return self._library(words)
        found: list[bytes] = []
        mark = np.frombuffer(self.mark, np.uint32)[0]
        for at in range(0, len(words), together):
            some = words[at : at + together]
            if any(MARK in w for w in some):
                found += self._library(some)
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(ids == mark) * 4
            data, begin = ids.tobytes(), 0
            for end in [*ends.tolist(), len(data)]:
                found.append(data[begin:end])
                begin = end + 4
        return found

    def _remember(self, word: str, ids: bytes) -> None:
        self.used += self.COST + len(word) + len(ids)
        if self.used > self.max_known:
            self.young, self.old, self.used = {}, self.young, 0
        self.young[word] = ids

    def _ids_of(self, distinct: list[str]) -> list[bytes]:
        found = list(map(self.young.get, distinct))
        unknown = [k for k, ids in enumerate(found) if ids is None]
        missing = []
        for k in unknown:
            ids = self.old.get(distinct[k])
            if ids is None:
                missing.append(k)
            else:
                found[k] = ids
                self._remember(distinct[k], ids)
        words = [distinct[k] for k in missing]
        for k, word, ids in zip(missing, words, self._encode_all(words), strict=True):
            found[k] = ids
            if len(word) <= 64:
                self._remember(word, ids)
        return found

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct part of each part, ids of the distinct parts, their offsets, first part of each word and the end)."""
        data, bounds = parts_of(words)
        texts = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))
        coded = texts.dictionary_encode()
        found = self._ids_of(coded.dictionary.to_pylist())
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
        return coded.indices.to_numpy(), np.frombuffer(b"".join(found), np.uint32), offsets, np.searchsorted(bounds, words.start)

    def lengths(self, words: Words) -> np.ndarray:
        if not words.count:
            return np.zeros(0, np.int64)
        which, _, offsets, first = self.encode(words)
        return counts_of(first, np.diff(offsets)[which])

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, offsets of the words in them)."""
        if not words.count:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        which, ids, offsets, first = self.encode(words)
        lens = np.diff(offsets)[which]
        at = np.concatenate([[0], np.cumsum(lens)])
        return ids[np.repeat(offsets[which] - at[:-1], lens) + np.arange(at[-1])], at[first]


def pieces(data: np.ndarray, offsets: np.ndarray, max_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of about ``max_bytes``: (row of each piece, bytes, offsets).

    A row longer than that is cut at safe places: after white space, or before a
    punctuation mark that follows an ASCII letter or digit. Only a longer run
    without any such place stays whole.
    """
    bounds = [int(offsets[0])]
    rows: list[int] = []
    for d in np.flatnonzero(np.diff(offsets) > max_bytes):
        begin, end = int(offsets[d]), int(offsets[d + 1])
        text = data[begin:end]
        safe = SAFE[text]
        safe[:-1] |= _ENDS_WORD[text[:-1]] & _BEGINS_MARKS[text[1:]]
        spaces = np.flatnonzero(safe) + begin + 1
        rows += [int(d)]
        at = begin
        while end - at > max_bytes:
            k = int(np.searchsorted(spaces, at + max_bytes, side="right")) - 1
            cut = int(spaces[k]) if k >= 0 and spaces[k] > at else int(spaces[k + 1]) if k + 1 < len(spaces) else end
            if cut >= end:
                break
            bounds.append(cut)
            at = cut
    cuts = np.union1d(offsets, np.array(bounds[1:], np.int64)) if len(bounds) > 1 else np.unique(offsets)
    row = np.searchsorted(offsets, cuts[:-1], side="right") - 1
    at = 0
    while at < len(cuts) - 1:
        last = int(np.searchsorted(cuts, cuts[at] + max_bytes, side="right")) - 1
        last = min(max(last, at + 1), len(cuts) - 1)
        yield row[at:last], data[cuts[at] : cuts[last]], cuts[at : last + 1] - cuts[at]
        at = last


def token_counts(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, max_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            tokens = np.zeros(batch.num_rows, np.int64)
            for rows, part, at in pieces(data, offsets, max_bytes):
                words = Words(part, at, SAFE, sep=0)
                np.add.at(tokens, rows, counts_of(words.first, encoder.lengths(words)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > max_tokens)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
