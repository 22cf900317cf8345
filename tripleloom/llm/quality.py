"""Weak-label quality classifier.

Two aspects are judged, form and toxicity, since what fails one says little about
the other. For each aspect overlapping heuristic labellers vote on each document:
reject, keep or abstain; people's labels, where there are any, are one more
labeller. The documents are counted by pattern of votes, and
expectation-maximisation over those counts estimates each labeller's votes on
documents worth keeping and on others, and with them each pattern's posterior.
The posteriors of a bounded sample train a linear scorer on hashed features
(words, word beginnings and how often they recur, shares of odd shapes, and the
evidence of the most telling features), which scores every document. The worse
aspect decides.

The evidence of a text is the sum of the largest log odds of its features, where
odds compare the sample's texts that should surely go with those that surely
stay; a text of the sample itself does not count for its own evidence. It lets a
few telling word beginnings of a language with few labels outweigh hundreds of
common words.

Counts and accuracies cover all documents; only the scorer is fitted on a sample
of at most about ``max_train`` documents.

Defined results: null text counts as empty, on which most labellers abstain;
repeated rows are scored each; labels of a doc_id that disagree count as reject;
a null doc_id has no label. Extra columns pass through; an empty table stays
empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm._text import Words, byte_set, counts_of, mix, raw, row_slices

LETTERS = np.zeros(256, bool)
LETTERS[ord("a") : ord("z") + 1] = LETTERS[ord("A") : ord("Z") + 1] = LETTERS[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SYMBOLS = byte_set(b"*#$%&!@^~=+<>|\\")
UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True

#: English insults.
INSULTS = ("idiot", "stupid", "moron", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "vermin")
#: Function words of the languages at hand.
ENGLISH = "the of and to in that was for with is it on be as are this by from or at".split()
FUNCTION_WORDS = [
    *ENGLISH,
    *"der die und den das mit für ist nicht ein eine auf zu von im".split(),
    *"de la le les et des que qui du pour dans un une est par sur au".split(),
    *"el los las en por con para una se del y no es".split(),
]

REJECT, KEEP, ABSTAIN = 1, 0, 2
ASPECTS = {
    "form": ("symbols", "capitals", "repeats", "separators", "function_words", "variety", "plain", "people_form"),
    "toxicity": ("insults", "many_insults", "insult_share", "no_insults", "people_toxicity"),
}
LABELLERS = tuple(x for names in ASPECTS.values() for x in names)
PLACES = 3 ** np.arange(len(LABELLERS))
BUCKETS = 1 << 18
#: Bytes of text worked on at once: features take a hundred times as much.
TEXT_BYTES = 1 << 20
#: Texts of the sample that a feature must occur in.
LEAST_TEXTS = 3
SHAPES = ("symbols", "capitals", "repeats", "separators", "function_words", "variety")
#: The first buckets are the shapes' and the evidence's own.
RESERVED = 128
EVIDENCE_CUTS = np.array([4, 6, 8, 10, 11, 12, 13, 14, 15, 16, 18, 20, 24])
EVIDENCE_FIRST = 64
#: Texts to go that a telling feature occurs in, and features that make up the evidence.
LEAST_KNOWN, MOST_TELLING = 5, 5
SHAPE_CUTS = np.array([0.001, 0.02, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8])


def word_hashes(words: tuple[str, ...] | list[str]) -> np.ndarray:
    texts = [w.encode() for w in words]
    data = np.frombuffer(b"".join(texts), np.uint8)
    return np.sort(Words(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])])).hashes())


class Signals:
    """What the labellers and the scorer see of a slice of texts."""

    def __init__(self, texts: pa.Array):
        data, offsets = raw(texts)
        self.words = Words(data, offsets)
        self.bare = Words(LOWER[data], offsets, ~LETTERS)
        first, n = self.words.first, np.diff(self.words.first)
        self.n = n
        hashes = self.words.hashes()
        ends = self.words.compact_start[1:] - 1
        last = self.words.compact[ends] if self.words.count else np.zeros(0, np.uint8)
        before = self.words.compact[np.maximum(ends - 1, self.words.compact_start[:-1])] if self.words.count else last
        again = np.zeros(self.words.count, bool)
        again[1:] = hashes[1:] == hashes[:-1]
        again[first[:-1][n > 0]] = False
        capitals = self._all(UPPER, self.words) & (self.words.lens >= 2)
        alone = (self.words.lens == 1) & SYMBOLS[last]
        share = lambda hit, f=first, k=n: counts_of(f, hit.astype(np.int64)) / np.maximum(k, 1)
        self.bare_hashes = self.bare.hashes()
        bare_n = np.diff(self.bare.first)
        owner = np.repeat(np.arange(len(bare_n)), bare_n)
        pairs = np.unique(mix(self.bare_hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        self.owner, self.distinct = owner, pairs
        kinds = np.bincount(owner[pairs], minlength=len(bare_n))
        self.shares = {
            "symbols": share(SYMBOLS[last] & SYMBOLS[before] & (self.words.lens > 1)),
            "capitals": share(capitals),
            "repeats": share(again),
            "separators": share(alone),
            "function_words": counts_of(self.bare.first, np.isin(self.bare_hashes, FUNCTION_HASHES).astype(np.int64)) / np.maximum(bare_n, 1),
            "variety": kinds / np.maximum(bare_n, 1),
        }
        self.insults = counts_of(self.bare.first, np.isin(self.bare_hashes, INSULT_HASHES).astype(np.int64))
        self.english = counts_of(self.bare.first, np.isin(self.bare_hashes, ENGLISH_HASHES).astype(np.int64)) / np.maximum(bare_n, 1)
        self.bare_n = bare_n

    @staticmethod
    def _all(table: np.ndarray, words: Words) -> np.ndarray:
        """Words whose ASCII letters are all in ``table`` and at least one is."""
        if not words.count:
            return np.zeros(0, bool)
        hit = table[words.compact]
        other = (LETTERS & ~table)[words.compact] & (words.compact < 128)
        at = words.compact_start[:-1]
        return (np.add.reduceat(hit.astype(np.int32), at) > 0) & (np.add.reduceat(other.astype(np.int32), at) == 0)

    def votes(self, form: np.ndarray, toxicity: np.ndarray) -> np.ndarray:
        """A vote of each labeller (columns) on each text."""
        s, n = self.shares, self.n
        odd = np.max([s["symbols"], s["capitals"], s["repeats"], s["separators"]], axis=0)

        def says(vote: int, when: np.ndarray) -> np.ndarray:
            return np.where(when, vote, ABSTAIN)

        return np.stack([
            says(REJECT, (n >= 5) & (s["symbols"] >= 0.25)),
            says(REJECT, (n >= 5) & (s["capitals"] >= 0.4)),
            says(REJECT, (n >= 5) & (s["repeats"] >= 0.3)),
            says(REJECT, (n >= 5) & (s["separators"] >= 0.2)),
            says(REJECT, (self.bare_n >= 60) & (s["function_words"] < 0.01)),
            says(REJECT, (self.bare_n >= 50) & (s["variety"] < 0.15)),
            says(KEEP, odd <= 0.05),
            form,
            says(REJECT, self.insults > 0),
            says(REJECT, self.insults > 1),
            says(REJECT, self.insults > 0.01 * self.bare_n),
            says(KEEP, (self.insults == 0) & (self.english > 0.1)),
            toxicity,
        ], axis=1)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, hashed feature) pairs, each once and in order of the text."""
        b = self.bare
        if b.count:
            width = 6
            lens = np.minimum(b.lens, width)
            begin = b.compact_start[:-1]
            take = np.repeat(begin - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(int(lens.sum()))
            stems = Words.__new__(Words)
            stems.compact, stems.lens, stems.count = b.compact[take], lens, b.count
            stems.compact_start = np.concatenate([[0], np.cumsum(lens)])
            stem = mix(stems.hashes() ^ np.uint64(0x57E3))
        else:
            stem = np.zeros(0, np.uint64)
        key = mix(stem + self.owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, at, times = np.unique(key, return_index=True, return_counts=True)
        texts, found = [self.owner[self.distinct]], [self.bare_hashes[self.distinct]]
        often = times / np.maximum(self.bare_n[self.owner[at]], 1) * (times > 1)
        for k, hit in enumerate((times >= 1, times >= 2, often >= 0.01, often >= 0.03)):
            some = at[hit]
            texts.append(self.owner[some])
            found.append(mix(stem[some] + np.uint64(k)))
        every = np.arange(len(self.n))
        hashed = (np.concatenate(found) % np.uint64(BUCKETS - RESERVED)).astype(np.int64) + RESERVED
        shapes = [np.searchsorted(SHAPE_CUTS, self.shares[name]) + (len(SHAPE_CUTS) + 1) * k for k, name in enumerate(SHAPES)]
        text, feature = np.concatenate(texts + [every] * len(SHAPES)), np.concatenate([hashed, *shapes])
        both = np.unique(text * BUCKETS + feature)
        return both // BUCKETS, both % BUCKETS


INSULT_HASHES, ENGLISH_HASHES, FUNCTION_HASHES = word_hashes(INSULTS), word_hashes(ENGLISH), word_hashes(FUNCTION_WORDS)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """EM over counted vote patterns: (posterior of reject of each pattern, accuracy of each labeller).

    A labeller is right with the same probability whatever it votes; to abstain
    says nothing, and before any vote both classes are as likely, so that a
    labeller that often votes alone is not taken for a wrong one.
    """
    counts = counts.astype(float)
    sign = np.where(patterns == REJECT, 1.0, np.where(patterns == KEEP, -1.0, 0.0))
    accuracy = np.full(patterns.shape[1], 0.95)
    for _ in range(rounds):
        z = sign @ np.log(accuracy / (1 - accuracy))
        posterior = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        right = np.where(sign > 0, posterior[:, None], 1 - posterior[:, None]) * (sign != 0)
        voted = ((sign != 0) * counts[:, None]).sum(axis=0)
        new = np.clip(((right * counts[:, None]).sum(axis=0) + 0.9) / (voted + 1.0), 0.55, 0.99)
        if np.abs(new - accuracy).max() < 1e-6:
            break
        accuracy = new
    return posterior, accuracy


def fit_scorer(sizes: np.ndarray, feature: np.ndarray, target: np.ndarray, rounds: int = 60, strength: float = 10.0, memory: int = 8) -> np.ndarray:
    """Weights of a logistic regression on binary features (L-BFGS); the last one is the bias.

    Text i has the next ``sizes[i]`` of ``feature``. Texts on which no labeller
    voted (target 0.5) take no part.
    """
    sure = np.abs(target - 0.5) > 0.1
    feature, sizes, target = feature[np.repeat(sure, sizes)], sizes[sure], target[sure]
    n, width = len(target), int(feature.max(initial=-1)) + 1
    weights = np.zeros(width + 1)
    if not n:
        return weights
    ends = np.cumsum(sizes)
    decay = np.append(np.full(width, 1.0 / (strength * n)), 0.0)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        total = np.concatenate([[0.0], np.cumsum(w[feature])])
        z = total[ends] - total[ends - sizes] + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - target
        grad = np.append(np.bincount(feature, np.repeat(error, sizes), width), error.sum()) / n + decay * w
        return float(np.mean(np.logaddexp(0, z) - target * z) + 0.5 * (decay * w * w).sum()), grad

    value, grad = loss(weights)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        step, notes = grad.copy(), []
        for s, y, r in reversed(pairs):
            notes.append(r * (s @ step))
            step -= notes[-1] * y
        if pairs:
            s, y, _ = pairs[-1]
            step *= (s @ y) / (y @ y)
        for (s, y, r), note in zip(pairs, reversed(notes), strict=True):
            step += s * (note - r * (y @ step))
        slope, rate = -(grad @ step), 1.0
        while True:
            new = weights - rate * step
            new_value, new_grad = loss(new)
            if new_value <= value + 1e-4 * rate * slope or rate < 1e-6:
                break
            rate /= 2
        s, y = new - weights, new_grad - grad
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y, 1.0 / (s @ y))][-memory:]
        done = abs(value - new_value) < 1e-7
        weights, value, grad = new, new_value, new_grad
        if done:
            break
    return weights


def log_odds(bad: np.ndarray, good: np.ndarray, all_bad: int, all_good: int) -> np.ndarray:
    """How much likelier a feature is in texts to go than in texts to stay; 0 for rare features and for others."""
    odds = np.log((bad + 0.5) / (all_bad + 1)) - np.log((good + 0.5) / (all_good + 1))
    return np.where(bad >= LEAST_KNOWN, np.maximum(odds, 0), 0).astype(np.float32)


def top_sums(text: np.ndarray, odds: np.ndarray, n: int) -> np.ndarray:
    """Sum of the largest ``odds`` of each text."""
    some = np.flatnonzero(odds > 0)
    some = some[np.lexsort((-odds[some], text[some]))]
    text = text[some]
    rank = np.arange(len(text)) - np.searchsorted(text, text)
    return np.bincount(text, np.where(rank < MOST_TELLING, odds[some], 0), n)


def evidence_features(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) for every cut that a text's evidence (a column for each aspect) reaches."""
    text, aspect, cut = np.nonzero(sums[:, :, None] >= EVIDENCE_CUTS)
    return text, EVIDENCE_FIRST + aspect * len(EVIDENCE_CUTS) + cut


def people_votes(labels: DataFrame) -> DataFrame:
    """_labelled (doc_id), form and toxicity: the people's votes on each labelled document."""

    def vote(bad):
        return F.coalesce(F.max(F.when(bad.isNull(), None).when(bad, REJECT).otherwise(KEEP)), F.lit(ABSTAIN)).cast("int")

    known = labels.where(F.col("doc_id").isNotNull())
    return known.groupBy(F.col("doc_id").cast("long").alias("_labelled")).agg(vote(F.col("quality") == 0).alias("form"), vote(F.col("toxic") == 1).alias("toxicity"))


def pattern_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The number of documents of each pattern of votes (a base-three number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, max_bytes=TEXT_BYTES):
                nobody = np.full(part.num_rows, ABSTAIN)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(Signals(part.column("text")).votes(nobody, nobody) @ PLACES)], ["doc_id", "pattern"])

    voted = docs.mapInArrow(run, "doc_id long, pattern long")
    people = people_votes(labels)
    joined = voted.join(people, voted.doc_id == people["_labelled"], "left")
    said = sum((F.coalesce(F.col(a), F.lit(ABSTAIN)) - ABSTAIN) * int(PLACES[LABELLERS.index(f"people_{a}")]) for a in ASPECTS)
    return joined.groupBy((F.col("pattern") + said).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def train(docs: DataFrame, labels: DataFrame, max_train: int = 8_000, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(the scorer's weights, the features' log odds), a row for each aspect. ``max_train`` bounds the sample that fits them."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = pattern_counts(docs, labels).collect()  # at most 3 ** labellers
    if not rows:
        return np.zeros((len(ASPECTS), BUCKETS + 1), np.float32), np.zeros((len(ASPECTS), BUCKETS), np.float32)
    codes = np.array([r.pattern for r in rows])
    counts = np.array([r.n for r in rows])
    patterns = codes[:, None] // PLACES % 3
    posteriors, at = [], 0
    for names in ASPECTS.values():
        posteriors.append(estimate(patterns[:, at : at + len(names)], counts)[0])
        at += len(names)
    known = dict(zip(codes.tolist(), np.stack(posteriors, axis=1).tolist(), strict=True))
    people = (patterns[:, [LABELLERS.index(f"people_{a}") for a in ASPECTS]] != ABSTAIN).any(axis=1)
    # three quarters of the sample with people's labels, as far as there are any
    with_people, without = int(counts[people].sum()), int(counts[~people].sum())
    scale = 1 << 40
    labelled_share = min(1.0, max_train * 3 / 4 / max(1, with_people))
    other_share = min(1.0, max(max_train / 4, max_train - with_people) / max(1, without))
    drawn = lambda c, share: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(scale)) < int(share * scale)
    votes = people_votes(labels.where(drawn(F.col("doc_id").cast("long"), labelled_share)))  # as bounded as the sample
    some = docs.where(drawn(F.col("doc_id"), max(labelled_share, other_share))).join(F.broadcast(votes), F.col("doc_id") == F.col("_labelled"), "left")
    some = some.where(F.col("_labelled").isNotNull() | drawn(F.col("doc_id"), other_share)).select("text", *(F.coalesce(a, F.lit(ABSTAIN)).alias(a) for a in ASPECTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, max_bytes=TEXT_BYTES):
                signals = Signals(part.column("text"))
                code = signals.votes(*(part.column(a).to_numpy() for a in ASPECTS)) @ PLACES
                text, feature = signals.features()
                bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
                targets = pa.array([known.get(v, [0.5] * len(ASPECTS)) for v in code.tolist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([targets, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(feature, pa.int32()))], ["targets", "features"])

    sample = some.mapInArrow(run, "targets array<double>, features array<int>").toArrow()
    features = sample.column("features").combine_chunks()
    sizes = features.value_lengths().to_numpy().astype(np.int64)
    feature = features.flatten().to_numpy()
    targets = sample.column("targets").combine_chunks().flatten().to_numpy().reshape(-1, len(ASPECTS))
    del sample, features
    odds, feature, sizes = with_evidence(feature, sizes, targets)
    # only features of several texts get a weight
    common = np.bincount(feature, minlength=BUCKETS) >= LEAST_TEXTS
    keep = common[feature]
    bounds = np.concatenate([[0], np.cumsum(keep)])
    ends = np.cumsum(sizes)
    feature, sizes = (np.cumsum(common) - 1)[feature[keep]], bounds[ends] - bounds[ends - sizes]
    out = np.zeros((len(ASPECTS), BUCKETS + 1), np.float32)
    places = np.flatnonzero(common)
    for k in range(len(ASPECTS)):
        weights = fit_scorer(sizes, feature, targets[:, k])
        out[k, places[: len(weights) - 1]], out[k, -1] = weights[:-1], weights[-1]
    return out, odds


def with_evidence(feature: np.ndarray, sizes: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log odds of every feature by aspect, features with those of the evidence, their sizes) of a sample's texts."""
    n, aspects = targets.shape
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    odds, sums = np.zeros((aspects, BUCKETS), np.float32), np.zeros((n, aspects))
    for k in range(aspects):
        bad, good = targets[:, k] > 0.9, targets[:, k] < 0.1
        a, b = (np.bincount(feature[x[owner]], minlength=BUCKETS) for x in (bad, good))
        odds[k] = log_odds(a, b, int(bad.sum()), int(good.sum()))
        telling = np.flatnonzero(odds[k][feature] > 0)
        f, o = feature[telling], owner[telling]
        # a text does not count for itself
        sums[:, k] = top_sums(o, log_odds(a[f] - bad[o], b[f] - good[o], int(bad.sum()), int(good.sum())), n)
    text, more = evidence_features(sums)
    order = np.argsort(np.concatenate([owner, text.astype(np.int32)]), kind="stable")
    return odds, np.concatenate([feature, more.astype(feature.dtype)])[order], sizes + np.bincount(text, minlength=n)


def reject_scores(texts: pa.Array, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The probability that each text should go, by its worse aspect."""
    weights, odds = model
    text, feature = Signals(texts).features()
    n = len(texts)
    more_text, more = evidence_features(np.stack([top_sums(text, one[feature], n) for one in odds], axis=1))
    z = np.max([np.bincount(text, one[feature], n) + np.bincount(more_text, one[more], n) + one[-1] for one in weights], axis=0)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, reject_score and keep of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))  # a fixed number of buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, max_bytes=TEXT_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(reject_scores(part.column("text"), shared.value))], ["doc_id", "reject_score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, reject_score double")
    return scored.withColumn("keep", F.col("reject_score") < threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` worth keeping, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, max_bytes=TEXT_BYTES):
                yield part.filter(pa.array(reject_scores(part.column("text"), shared.value) < threshold))

    return docs.mapInArrow(run, docs.schema)
