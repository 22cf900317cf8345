import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import ODD
from tripleloom.llm._text import Words, raw
from tripleloom.llm.packing import OpenWindows, encoded, pack
from tripleloom.llm.token_counts import SAFE, WordEncoder, pieces, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("max_bytes", [64, 1 << 24])
def test_counts_equal_the_library(odd, tokenizer, max_bytes):
    found = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(odd, PATH, max_bytes=max_bytes).collect())
    expected = sorted((i or 0, len((t or "").encode()), len(ids_of(tokenizer, t)), len(ids_of(tokenizer, t)) > 2048) for i, t, *_ in ODD)
    assert found == expected


PIECES = ["'", "'s", "'T", "'re", "'LL", "'ve", "a", "B", "H", "é", "e\u0301", "\u0331", "İ", "Σ", "\u212a", "1", "2", "٣", "½", "!", "-", ".", "|", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "\x01", "\x0b", "\x1c", "\x7f", "\xa0", "\x85", "\u3000", " ", "\n", "漢", "’", "’s", "😀", "\u200d", "l", "v", "s", "\u1100", "\u1161", "ﬁ"]


@pytest.mark.parametrize("max_bytes", [16, 1 << 22])
def test_ids_of_odd_texts_equal_the_library(tokenizer, max_bytes):
    """Forms on both sides of every cut: contractions, digits, marks, combining characters, special tokens."""
    rng = random.Random(7)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 25))) for _ in range(4000)]
    encoder = WordEncoder(PATH, max_known=50_000)  # so small that both generations turn over
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    found = dict(encoded(batch, encoder, 2, max_bytes))
    for row, text in enumerate(texts):
        assert found[row].tolist() == ids_of(tokenizer, text) + [2], text
    assert encoder.used <= 50_000


def test_a_run_without_white_space_is_cut_at_safe_places(tokenizer):
    text = "ab.c3-don't;" * 5000
    data, offsets = raw(pa.array([text]))
    parts = list(pieces(data, offsets, 1000))
    assert len(parts) > 50 and max(len(p[1]) for p in parts) <= 1000
    encoder = WordEncoder(PATH)
    assert sum(int(encoder.lengths(Words(p, at, SAFE, sep=0)).sum()) for _, p, at in parts) == len(ids_of(tokenizer, text))


def test_ids_of_documents_of_any_integer_type(docs_of):
    docs = docs_of([(1, "one two"), (2, None)]).withColumn("doc_id", F.col("doc_id").cast("int"))
    assert {(r.doc_id, r.n_tokens) for r in token_counts(docs, PATH).collect()} == {(1, 2), (2, 0)}
    assert {(r.doc_id, r.doc_tokens) for r in pack(docs, PATH).collect()} == {(1, 3), (2, 1)}


def test_empty_tables(empty):
    assert token_counts(empty, PATH).count() == 0
    assert pack(empty, PATH).count() == 0


@pytest.mark.parametrize("window,most", [(4096, 32), (64, 2)])
def test_packing_is_an_exact_round_trip(odd, tokenizer, window, most):
    rows = pack(odd, PATH, window=window, open_windows=most, with_ids=True).collect()
    sequences, docs = {}, {}
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    expected = sorted(ids_of(tokenizer, t) + [2] for _, t, *_ in ODD)
    found = []
    for (_, total), pieces in docs.items():
        copies = sum(len(i) for _, i in pieces) // total
        starts = {}
        for start, ids in sorted(pieces):
            starts.setdefault(start, []).append(ids)
        for k in range(copies):
            ids = [x for s in sorted(starts) for x in starts[s][k]]
            assert len(ids) == total
            found.append(ids)
    assert sorted(found) == expected


def test_little_padding(docs_of):
    rng = np.random.default_rng(3)
    docs = docs_of([(i, "a " * int(rng.integers(1, 3000))) for i in range(600)]).coalesce(3)
    used = pack(docs, PATH).groupBy("sequence_id").sum("length").collect()
    assert sum(r[1] for r in used) / (4096 * len(used)) > 0.97


def test_windows_are_best_fit_and_bounded():
    w = OpenWindows(10, 2)
    assert w.place(("a",), 4) is None and w.place(("b",), 7) is None
    assert w.place(("c",), 3) == [("b",), ("c",)]  # best fit fills the fuller window
    assert w.place(("d",), 8) is None
    assert w.place(("e",), 9) == [("d",)]  # none fits: the fullest leaves
