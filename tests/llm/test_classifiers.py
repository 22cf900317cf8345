import itertools
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tripleloom.llm._text import counts_of, raw
from tripleloom.llm.decontaminate import drop_leaks, find_leaks
from tripleloom.llm.language_id import SCRIPTS, TABLE_END, Distinct, best_paths, decoded, identify, label, letter_words, shares, train
from tripleloom.llm.license_scan import FAMILIES, TEMPLATES, license_report, required_words, scan
from tripleloom.llm.license_scan import train as train_licences
from tripleloom.llm.quality import ABSTAIN, EVIDENCE_CUTS, EVIDENCE_FIRST, KEEP, LEAST_KNOWN, MOST_TELLING, REJECT, classify, estimate, keep_good, with_evidence

EN = "the of and to in that was for with is house water people little great under never before again while".split()
DE = "der die und den das mit für ist nicht ein haus wasser leute klein groß unter niemals vorher wieder während".split()
RU = "и в не на что быть дом вода люди маленький большой под никогда раньше снова пока".split()


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def tongues(docs_of):
    rng = random.Random(1)
    rows = [(i, prose(rng, w, rng.randrange(3, 60)), lang) for i, (lang, w) in enumerate(itertools.islice(itertools.cycle([("en", EN), ("de", DE), ("ru", RU)]), 300))]
    return docs_of(rows)


def test_held_out_accuracy(tongues):
    found = identify(tongues).join(tongues.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out]
    assert len(held) > 40 and np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_mixed_text_is_labelled_by_spans(tongues, docs_of):
    rng = random.Random(2)
    model = train(tongues, F.lit(True))
    (row,) = label(docs_of([(1, prose(rng, EN, 30) + ". " + prose(rng, DE, 20) + " " + prose(rng, RU, 15))]), model).collect()
    assert [s.lang for s in row.spans] == ["en", "de", "ru"] and sum(s.words for s in row.spans) == 65
    assert abs(row.spans[1].first_word - 30) <= 2


def test_language_of_odd_rows(odd, empty, tongues):
    found = identify(odd.unionByName(tongues)).where("doc_id is null or doc_id < 11").collect()
    und = {r.doc_id for r in label(odd, train(tongues, F.lit(True))).collect() if r.lang_pred == "und"}
    assert und == {2, 3, 4, 10} and len(found) >= len(ODD)
    assert identify(empty).count() == 0
    assert {r.lang_pred for r in identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("text,script,letters", [("«Привет»", "cyrillic", 6), ("“Hello", "latin", 5), ("‘tis", "latin", 3), ("（日本）", "han", 2), ("Ếch", "latin", 3), ("Ａｂｃ", "latin", 3), ("e\u0301te\u0301", "latin", 3), ("ไทย", "thai", 3), ("Ελλάδα", "greek", 6), ("한국", "hangul", 2), ("𠀀字", "han", 2)])
def test_scripts_of_words(text, script, letters):
    words = letter_words(pa.array(["— 12 … " + text + " 😀"]))
    assert words.count == 1 and words.letters.tolist() == [letters]
    assert SCRIPTS[Distinct(words).scripts[0]] == script


def test_decoded_text_and_letters_equal_python():
    rng = random.Random(1)
    texts = ["".join(chr(rng.choice([rng.randrange(128), rng.randrange(0x80, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(40))) for _ in range(200)]
    data, offsets = raw(pa.array(texts))
    assert decoded(data)[1].tolist() == [ord(c) for t in texts for c in t]
    letters = [sum(unicodedata.category(c)[0] == "L" and ord(c) < TABLE_END for c in t) for t in texts]
    words = letter_words(pa.array(texts))
    assert counts_of(words.first, words.letters).tolist() == letters


def test_ties_go_to_the_first_language_and_shares_favour_the_rare(docs_of):
    same = docs_of([(i, "alpha beta gamma", lang) for i, lang in enumerate(["b", "a"] * 4)])
    assert {r.lang_pred for r in label(same, train(same, F.lit(True))).collect()} == {"a"}
    assert shares({"x": 10, "y": 1000, "z": 1000}, 110) == {"x": 1.0, "y": 0.05, "z": 0.05}


def test_best_paths_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(150):
        size, lens, penalty = int(rng.integers(2, 4)), rng.integers(0, 7, 4), float(rng.uniform(0, 4))
        first = np.concatenate([[0], np.cumsum(lens)])
        scores = rng.normal(0, 2, (first[-1], size))
        path = best_paths(scores, first, penalty)

        def value(way, at, scores=scores, penalty=penalty):
            return sum(scores[at + i, x] for i, x in enumerate(way)) - penalty * sum(x != y for x, y in zip(way, way[1:], strict=False))

        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b > a:
                best = max(value(w, a) for w in itertools.product(range(size), repeat=b - a))
                assert abs(value(path[a:b].tolist(), a) - best) < 1e-9


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, [f"b{k}" for k in range(500)], n)) for i, n in enumerate([5, 12, 30, 60, 200, 4, 0])]
    return spark.createDataFrame([*rows, (7, None), (8, rows[2][1])], "item_id long, text string")


def test_leaks_equal_exact_containment(docs_of, bench):
    rng = random.Random(5)
    items = {r.item_id: (r.text or "").split() for r in bench.collect()}
    rows = []
    for i in range(150):
        t = prose(rng, [f"d{k}" for k in range(300)], rng.randrange(0, 3000)).split()
        for k in rng.sample(sorted(items), rng.randrange(3)):
            w = list(items[k])
            for _ in range(rng.randrange(3)):
                if w:
                    w[rng.randrange(len(w))] = "other"
            at = rng.randrange(len(t) + 1)
            t[at:at] = [x.upper() for x in w[: rng.choice([len(w), len(w), len(w) * 9 // 10])]]
        rows.append((i, "\n".join(t)))
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    expected = set()
    for i, t in rows:
        own = shingles(t.lower().split())
        for k, w in items.items():
            s = shingles(w)
            if s and len(s & own) >= 0.8 * len(s):
                expected.add((i, k, len(s & own), len(s)))
    docs = docs_of(rows)
    assert len(expected) > 40
    for block in (20_000, 2):
        assert {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in find_leaks(docs, bench, block_items=block).collect()} == expected
    kept = drop_leaks(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {x[0] for x in expected}


def test_leaks_in_odd_rows(odd, empty, bench):
    assert find_leaks(odd, bench).count() == 0 and drop_leaks(odd, bench).count() == len(ODD)
    assert find_leaks(empty, bench).count() == 0
    assert find_leaks(odd, bench.where("false")).count() == 0
    assert find_leaks(odd, odd.select(F.col("doc_id").alias("item_id"), "text")).where("item_id = 1").count() == 4


def test_shortest_items_are_all_found(docs_of, spark):
    rng = random.Random(12)
    items = {i: [f"i{i}x{k}" for k in range(5 + i % 9)] for i in range(4000)}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    rows, expected = [], set()
    for i, w in items.items():
        # in the first block, where one window alone holds it, and cut as far as 0.8 allows
        n = len(w) - 4
        cut = w[: len(w) - n // 5] if i % 2 else w
        rows.append((i, " ".join([*[f"a{i}y{k}" for k in range(rng.randrange(3))], *cut, *[f"b{i}y{k}" for k in range(60)]])))
        expected.add((i, i, len(cut) - 4, n))
    docs = docs_of(rows)
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in find_leaks(docs, bench).collect()} == expected
    assert drop_leaks(docs, bench).count() == 0


def quality_rows(seed, n):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        kind = rng.choice(["good", "good", "good", "symbols", "capitals", "repeats", "toxic"])
        t = prose(rng, EN + [f"{rng.choice(EN)}{rng.choice(EN)}" for _ in range(30)], rng.randrange(40, 120))
        if kind == "symbols":
            t = " ".join(w + "***" for w in t.split())
        elif kind == "capitals":
            t = t.upper().replace(" ", "!! ")
        elif kind == "repeats":
            t = " ".join(w for w in t.split() for _ in range(8))
        elif kind == "toxic":
            w = t.split()
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum", "stupid"]))
            t = " ".join(w)
        rows.append((i, t))
        if i % 3 == 0:
            labels.append((i, int(kind in ("good", "toxic")), int(kind == "toxic"), kind))
    return rows, labels


def test_classifier_on_labels_it_has_not_seen(docs_of, spark):
    rows, labels = quality_rows(1, 900)
    seen = spark.createDataFrame([x[:3] for x in labels[::2]], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.keep for r in classify(docs_of(rows), seen).collect()}
    right = [found[i] == (q == 1 and t == 0) for i, q, t, _ in labels[1::2]]
    assert len(found) == len(rows) and np.mean(right) > 0.97


def test_classifier_on_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 0, 1), (10, None, None)], "doc_id long, quality int, toxic int")
    assert classify(odd, labels).count() == len(ODD) and classify(odd, labels.where("false")).count() == len(ODD)
    assert classify(empty, labels).count() == 0
    kept = keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= len(ODD)


def test_estimate_finds_the_poor_labeller():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    votes = np.full((4000, 4), ABSTAIN)
    for j, (accuracy, coverage) in enumerate([(0.95, 0.6), (0.9, 0.6), (0.6, 0.6), (0.97, 0.3)]):
        says = np.where(rng.random(4000) < accuracy, truth, ~truth)
        votes[:, j] = np.where(rng.random(4000) < coverage, np.where(says, REJECT, KEEP), ABSTAIN)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, accuracy = estimate(patterns, counts)
    assert np.abs(accuracy - [0.95, 0.9, 0.6, 0.97]).max() < 0.06


def test_licences(docs_of, odd, empty):
    rng = random.Random(6)
    families = sorted(TEMPLATES)
    rows = [(i, prose(rng, EN, 40) + "\n" + TEMPLATES[families[i % len(families)]][0] + "\n" + prose(rng, EN, 30)) for i in range(60)]
    rows += [(100 + i, prose(rng, EN, 60) + "\nthe license of the house is under the water") for i in range(60)]
    found = {r.doc_id: r for r in license_report(docs_of(rows)).collect()}
    assert all(found[i].families == families[i % len(families)] and found[i].n_paragraphs == 3 for i in range(60))
    assert all(found[100 + i].n_licensed == 0 for i in range(60))
    assert license_report(odd).count() == len(ODD)
    assert license_report(empty).count() == 0 and scan(empty).count() == 0


def test_estimate_equals_plain_em_over_rows():
    """Counted patterns give what expectation-maximisation over single documents gives."""
    rng = random.Random(4)
    rows = [[rng.choice([REJECT, REJECT, KEEP, ABSTAIN]) if bad else rng.choice([KEEP, KEEP, REJECT, ABSTAIN]) for _ in range(4)] for bad in (rng.random() < 0.4 for _ in range(300))]
    accuracy = [0.95] * 4
    for _ in range(200):
        posterior = []
        for votes in rows:
            z = sum(math.log(a / (1 - a)) * (1 if v == REJECT else -1) for a, v in zip(accuracy, votes, strict=True) if v != ABSTAIN)
            posterior.append(1 / (1 + math.exp(-z)))
        new = []
        for j in range(4):
            said = [(p if v[j] == REJECT else 1 - p) for p, v in zip(posterior, rows, strict=True) if v[j] != ABSTAIN]
            new.append(min(0.99, max(0.55, (sum(said) + 0.9) / (len(said) + 1))))
        done = max(abs(a - b) for a, b in zip(accuracy, new, strict=True)) < 1e-6
        if done:
            break
        accuracy = new
    patterns, inverse, counts = np.unique(np.array(rows), axis=0, return_inverse=True, return_counts=True)
    found, estimated = estimate(patterns, counts)
    assert np.allclose(estimated, accuracy, atol=1e-5) and np.allclose(found[inverse], posterior, atol=1e-5)


def test_evidence_equals_a_plain_computation():
    rng = random.Random(9)
    texts = [sorted(rng.sample(range(200, 230), rng.randrange(1, 12))) for _ in range(60)]
    targets = np.array([[rng.choice([0.01, 0.5, 0.99]) for _ in range(2)] for _ in texts])
    sizes = np.array([len(t) for t in texts])
    odds, feature, new_sizes = with_evidence(np.array(sum(texts, []), np.int32), sizes, targets)
    at = 0
    for d, text in enumerate(texts):
        expected = list(text)
        for k in range(2):
            def value(f, own, k=k):
                rest = [x for i, x in enumerate(texts) if own is None or i != own]
                kept = [targets[i][k] for i in range(len(texts)) if own is None or i != own]
                bad = sum(f in x and t > 0.9 for x, t in zip(rest, kept, strict=True))
                good = sum(f in x and t < 0.1 for x, t in zip(rest, kept, strict=True))
                n_bad, n_good = (targets[:, k] > 0.9).sum(), (targets[:, k] < 0.1).sum()
                return max(0.0, math.log((bad + 0.5) / (n_bad + 1)) - math.log((good + 0.5) / (n_good + 1))) if bad >= LEAST_KNOWN else 0.0

            assert all(abs(odds[k][f] - value(f, None)) < 1e-5 for f in text)
            # a feature that only the text itself makes telling is none
            total = sum(sorted((value(f, d) for f in text if value(f, None) > 0), reverse=True)[:MOST_TELLING])
            expected += [EVIDENCE_FIRST + k * len(EVIDENCE_CUTS) + c for c, cut in enumerate(EVIDENCE_CUTS) if total >= cut]
        assert sorted(feature[at : at + new_sizes[d]].tolist()) == sorted(expected)
        at += new_sizes[d]


def test_telling_beginnings_of_a_language_with_few_labels(docs_of, spark):
    """Of 40 languages' worth of words, texts to go share one beginning; a few labels are enough for the others."""
    rng = random.Random(11)
    syllables = [a + b for a in "bdfgklmn" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(4))
    rows, labels = [], []
    for i in range(1200):
        bad = i % 8 == 0
        w = [word() for _ in range(150)]
        for _ in range(5 if bad else 0):
            w.insert(rng.randrange(len(w)), "zorkru" + word())
        rows.append((i, " ".join(w)))
        if i % 3 == 0:
            labels.append((i, 1, int(bad)))
    found = {r.doc_id: r.keep for r in classify(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    unseen = [i for i in range(1200) if i % 3]
    assert np.mean([not found[i] for i in unseen if i % 8 == 0]) >= 0.95 and np.mean([found[i] for i in unseen if i % 8]) >= 0.98


def licence_words(text):
    return [w for w in re.split(r"[^\w]+|_", text.lower()) if w]


def pairs(words):
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def paraphrases():
    """Wordings that no template has, and licence-like prose that is none."""
    rng = random.Random(2)
    for family, texts in TEMPLATES.items():
        for text in texts:
            w = text.split()
            yield family, f"{prose(rng, EN, 4)} {text} {prose(rng, EN, 5)}"
            if len(w) > 6:
                yield family, " ".join(w[:-1])
                yield family, " ".join(w[1:])
                yield family, " ".join([*w[:4], "kindly", *w[4:]])
                yield family, text.upper().replace(" ", "  ")
    for text in ("the license of the house is under the water", "all rights are reserved for little people", "he was licensed under great water", "permission to the house is granted", "a copy of this book"):
        yield "", text


@pytest.fixture(scope="module")
def licence_docs(docs_of):
    rng = random.Random(6)
    rows = [(i, prose(rng, EN, 30) + "\n" + text) for i, (_, text) in enumerate(paraphrases())]
    return docs_of(rows + [(1000 + i, prose(rng, EN, 60)) for i in range(80)])


def test_licences_equal_a_plain_computation(licence_docs):
    """Every paragraph's score and cover, without the words that are looked for first."""
    found = {(r.doc_id, r.pos): (r.family, round(r.probability, 6), round(r.cover, 6)) for r in scan(licence_docs, max_unknown=60).collect()}
    table, intercepts, temperature = train_licences(licence_docs, max_unknown=60)
    weights = {r.gram: r.weights for r in table.collect()}
    expected = {}
    for row in licence_docs.collect():
        for pos, line in enumerate(row.text.split("\n")):
            words = licence_words(line)
            grams = [g for g in {*words, *pairs(words)} if g in weights]
            z = [(b + sum(weights[g][k] for g in grams)) / temperature for k, b in enumerate(intercepts)]
            k = z.index(max(z))
            p = 1 / sum(math.exp(x - z[k]) for x in z)
            if FAMILIES[k] == "unknown" or p < 0.5:
                continue
            cover = max(len(pairs(licence_words(t)) & pairs(words)) / len(pairs(licence_words(t))) for t in TEMPLATES[FAMILIES[k]])
            if cover >= 0.6:
                expected[row.doc_id, pos] = (FAMILIES[k], round(p, 6), round(cover, 6))
    assert len(expected) > 60 and found == expected


def test_licences_in_other_words(licence_docs):
    found = {r.doc_id: r.families for r in license_report(licence_docs).collect()}
    truth = [family for family, _ in paraphrases()]
    right = [found[i] == family for i, family in enumerate(truth)]
    assert np.mean([x for x, f in zip(right, truth, strict=True) if f]) >= 0.95
    assert all(x for x, f in zip(right, truth, strict=True) if not f) and all(found[1000 + i] == "" for i in range(80))


@pytest.mark.parametrize("cover", [0.3, 0.6, 0.9])
def test_required_words_miss_no_cover(cover):
    """Any part of a template that covers enough of its pairs has one of the words."""
    rng = random.Random(3)
    words = required_words(cover)
    for text in (t for ts in TEMPLATES.values() for t in ts):
        own = licence_words(text)
        for _ in range(300):
            part = own[rng.randrange(len(own)) :][: rng.randrange(1, len(own) + 1)]
            if len(pairs(part) & pairs(own)) >= cover * len(pairs(own)):
                assert any(all(w in " ".join(part) for w in form) for form in words)
    assert required_words(0.0) == []


def test_repeated_rows_do_not_change_a_score(docs_of):
    """Three copies of a text, with and without an id, answer what one does."""
    texts = ["this program is free software under the license", "the GNU general license of this library", TEMPLATES["mit"][0]]
    for ids in ([1, 2, 3], [None] * 3):
        one, three = (docs_of([(i, t) for i, t in zip(ids, texts, strict=True) for _ in range(n)]) for n in (1, 3))
        answer = [sorted(set((r.version, r.family, round(r.probability, 9)) for r in scan(x, min_probability=0.0, min_cover=0.0).collect())) for x in (one, three)]
        assert answer[0] == answer[1]
        assert license_report(three).count() == 9
