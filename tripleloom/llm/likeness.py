"""Shingle sets of texts: classes of equal sets, SimHash and MinHash to probe by, exact likeness.

The likeness of two texts is the Jaccard likeness of their sets of ``k``-word
shingles, A-Z in lower case. Texts of likeness J share one of ``BANDS`` keys of
``ROWS`` minima each but for a chance of (1 - J^ROWS)^BANDS: 3e-8 at 0.8, less
above. Keys only propose; what is linked is decided on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tripleloom.llm._text import Words, mix, raw, shingle_hashes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BANDS, ROWS = 24, 3
_FACTORS, _TERMS = np.random.default_rng(17).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)
#: Hashes worked on at once.
STEP = 1 << 16


def slice_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, class): text d has the sorted distinct shingle hashes first[d]..first[d + 1].

    Texts of equal sets have equal classes. A text of fewer than ``k`` words has
    no shingles; its class is that of its words in order.
    """
    data, offsets = raw(texts)
    words = Words(LOWER[data], offsets)
    starts = words.shingle_starts(k)
    word_hashes = words.hashes()
    hashes = shingle_hashes(word_hashes, k)[starts] if len(starts) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, words.first)))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes), dtype=np.uint64)])
    classes = mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64))
    for d in np.flatnonzero(np.diff(first) == 0).tolist():
        h = np.uint64(0xE117)
        for w in word_hashes[words.first[d] : words.first[d + 1]]:
            h = mix(np.array([h ^ w]))[0]
        classes[d] = h
    return hashes, first, classes


def slice_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``BANDS`` keys (a row) of each text that has shingles."""
    full = first[:-1][np.diff(first) > 0]
    keys = np.zeros((len(full), BANDS), np.uint64)
    ends = np.append(full[1:], len(hashes))
    lo = 0
    while lo < len(full):
        hi = max(lo + 1, int(np.searchsorted(ends, full[lo] + STEP, side="right")))
        some, at = hashes[full[lo] : ends[hi - 1]], full[lo:hi] - full[lo]
        for b in range(BANDS):
            key = np.full(hi - lo, b + 1, np.uint64)
            for f in range(b * ROWS, (b + 1) * ROWS):
                key = mix(key ^ np.minimum.reduceat(some * _FACTORS[f] + _TERMS[f], at))
            keys[lo:hi, b] = key
        lo = hi
    return keys


def set_fingerprints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The 64-bit SimHash of each text's set; an even vote on a bit goes with the least hash, an empty set has zero."""
    sizes = np.diff(first)
    full = np.flatnonzero(sizes)
    out = np.zeros(len(sizes), np.uint64)
    ends = first[1:][full]
    lo = 0
    while lo < len(full):
        start = first[full[lo]]
        hi = max(lo + 1, int(np.searchsorted(ends, start + STEP, side="right")))
        some, at = mix(hashes[start : ends[hi - 1]]), first[full[lo:hi]] - start
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = 2 * np.add.reduceat(bits, at, axis=0, dtype=np.int64) + bits[at]
        out[full[lo:hi]] = np.packbits(ones > sizes[full[lo:hi], None], axis=1, bitorder="little").view(np.uint64).ravel()
        lo = hi
    return out


def alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets have a likeness of ``threshold`` or more."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)) - 1e-9:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= threshold * (len(both) - shared) - 1e-9
