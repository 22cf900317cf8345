import hashlib
import random

from tests.llm.conftest import ODD
from tripleloom.llm.fingerprints import edited_copies, fingerprint, fingerprint_texts, likeness, sign_likeness, squeezed


def test_pairs_follow_in_descending_order(docs_of, spark):
    rng = random.Random(1)
    rows = [(rng.randrange(10**12), "".join(rng.choice("abc de\n") for _ in range(rng.randrange(300)))) for _ in range(400)]
    found = {r.doc_id: r for r in edited_copies(docs_of(rows).repartition(7)).collect()}
    ordered = sorted(rows, reverse=True)
    assert len(found) == len(rows)
    for k, (i, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint(text.encode()), fingerprint(edited.encode()))
        assert r.near_edited == likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == likeness(r.fingerprint, fingerprint(after.encode()))


def test_odd_rows(odd, empty, docs_of):
    assert len(edited_copies(odd).collect()) == len(ODD)
    assert edited_copies(empty).count() == 0
    (one,) = edited_copies(docs_of([(4, "abcd")])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    assert {r.fingerprint for r in fingerprint_texts(odd).where("doc_id in (2, 3)").collect()} == {"3::"}


def test_edits_stay_near_and_strangers_far():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    text, other = " ".join(words[:2000]), " ".join(words[2000:])
    changed = " ".join([*words[:700], "inserted", "words", *words[700:2000]])
    a, b, c = (fingerprint(t.encode()) for t in (text, changed, other))
    assert likeness(a, b) > 0.85 and likeness(a, c) == 0.0 and likeness(a, a) == 1.0


def test_sign_likeness_equals_the_plain_algorithm():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("ABC") for _ in range(rng.randrange(4, 30))) for _ in range(2))
        x, y = squeezed(a), squeezed(b)
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
        score = sign_likeness(a, b)
        assert score == 0.0 or abs(score - 2 * table[-1][-1] / (len(x) + len(y))) < 1e-12


def test_long_periodic_text_has_a_short_fingerprint():
    assert len(fingerprint(b"abcdefgh" * 200_000)) < 400
