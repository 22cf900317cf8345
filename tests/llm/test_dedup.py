import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tripleloom.llm import _session
from tripleloom.llm.line_dedup import drop_boilerplate, line_report
from tripleloom.llm.simhash import Forest, correlated_parts, components, near_duplicates, one_of_each, plan_search, probes_of
from tripleloom.llm.substring_dedup import remove_repeats

WORD = re.compile("[^\x20\x09-\x0d]+")


def texts(seed, n, vocabulary=40, copies=True):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    out = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randrange(80))]
        if copies and out and rng.random() < 0.5:
            other = WORD.findall(rng.choice(out)[1])
            a = rng.randrange(len(other) + 1)
            t[rng.randrange(len(t) + 1) : 0] = other[a : a + rng.randrange(50)]
        out.append((i * 3 + 1, rng.choice([" ", "\n", "  "]).join(t)))
    return out


def removed_by_brute_force(rows, width):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i or 0, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


@pytest.mark.parametrize("width,minimiser", [(13, 3), (5, 2), (4, 4)])
def test_repeats_equal_brute_force(docs_of, width, minimiser):
    rows = texts(width, 120, vocabulary=6 if width < 10 else 40)
    found = remove_repeats(docs_of(rows).repartition(5), width, minimiser).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in found) == removed_by_brute_force(rows, width)


def test_repeats_in_odd_rows(odd, empty):
    found = remove_repeats(odd).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in found) == removed_by_brute_force([r[:2] for r in ODD], 13)
    assert remove_repeats(empty).count() == 0


def test_many_copies_of_one_passage(docs_of):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(400)]
    found = {r.doc_id: r for r in remove_repeats(docs_of(rows).repartition(6)).collect()}
    assert found[0].n_removed == 0 and all(found[i].n_removed == 60 for i in range(1, 400))


def simhash(text, k):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_brute_force(rows, k, radius):
    prints = [simhash(t, k) for _, t in rows]
    forest = Forest()
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                forest.join(a, b)
    groups = {}
    for a in range(len(rows)):
        groups.setdefault(forest.find(a), []).append(a)
    out = []
    for members in groups.values():
        ids = [rows[a][0] for a in members if rows[a][0] is not None]
        out += [(rows[a][0] or 0, f"{prints[a]:016x}", min(ids) if ids else None) for a in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("radius,frequent", [(0, 1000), (4, 1000), (9, 1000), (4, 1)])
def test_near_duplicates_equal_brute_force(docs_of, radius, frequent, monkeypatch):
    monkeypatch.setattr(_session, "LEAST_HOT", frequent)  # 1: every group of two or more counts as frequent
    rng = random.Random(5)
    rows = texts(9, 60, copies=False)
    for i, t in list(rows):
        w = t.split()
        for c in range(rng.randrange(4)):
            if w:
                w[rng.randrange(len(w))] = f"changed{c}"
            rows.append((1000 + 10 * i + c, " ".join(w)))
    found = near_duplicates(docs_of(rows), radius=radius).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=repr) == components_by_brute_force(rows, 4, radius)


def test_near_duplicates_of_odd_rows(odd, empty):
    found = near_duplicates(odd).collect()
    assert sorted(((r.doc_id or 0, r.fingerprint, r.component_id) for r in found), key=repr) == components_by_brute_force([r[:2] for r in ODD], 4, 4)
    assert near_duplicates(empty).count() == 0
    kept = one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 6, 7, 8, 9, 10]


def test_hot_buckets_are_split_without_losing_links(spark):
    from tripleloom.llm.simhash import links

    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**62))
    fps = sorted({base ^ int(sum(1 << int(b) for b in rng.choice(12, rng.integers(0, 4), replace=False))) for _ in range(300)} | {int(x) for x in rng.integers(0, 2**62, 300)})
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r.node: r.root for r in components(links(table, 4, block=16)).collect()}
    forest = Forest()
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                forest.join(a, b)
    assert all(roots.get(x, x) == forest.find(x) for x in fps)


def test_a_task_links_a_chain_as_one_star():
    from tripleloom.llm.simhash import spanning_links

    fps = np.array([(1 << i) - 1 for i in range(40)] + [-1], np.int64)
    cells, every = np.array([5] * 40 + [6]), np.ones(41, bool)
    assert sorted(spanning_links(cells, fps, every, every, 1)) == [((1 << i) - 1, 0) for i in range(1, 40)]


@pytest.mark.parametrize("edges, stars", [([(9, 1), (8, 1), (1, 7), (5, 4)], True), ([(i, i + 1) for i in range(60)] + [(70, i) for i in range(80, 200)], False), ([], True)])
def test_stars_take_no_round(spark, monkeypatch, edges, stars):
    from tripleloom.llm import simhash

    joins = []
    monkeypatch.setattr(simhash, "join_counted", lambda *a: (joins.append(1), _session.join_counted(*a))[1])
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    forest = Forest()
    for a, b in edges:
        forest.join(a, b)
    assert found == {x: forest.find(x) for x in list(forest.parent) if forest.find(x) != x} and (not joins) == stars


def test_plans_meet_the_pigeonhole_bound():
    sample = np.random.default_rng(0).integers(-(2**63), 2**63, 500)
    for radius in (0, 1, 4, 7, 10):
        for n in (100, 10**6, 10**9):
            plan = plan_search(sample, n, radius)
            if radius:
                assert sum(t for _, t in plan) >= radius - len(plan) + 1
            assert sorted(b for bits, _ in plan for b in bits) == list(range(64))
            assert probes_of(plan)
    assert sorted(len(g) for g in correlated_parts(np.eye(64), 5)) == [12, 13, 13, 13, 13]


@pytest.mark.parametrize("options", [{}, {"most_broadcast": 0}, {"margin": 10.0}])
def test_boilerplate_equals_brute_force(docs_of, options):
    rng = random.Random(8)
    lines = [f"boilerplate line number {k} of the site" for k in range(12)]
    rows = []
    for i in range(200):
        own = [rng.choice(lines[: 1 + i % 12]) for _ in range(rng.randrange(6))] + [f"own text of {i}", "short"]
        rng.shuffle(own)
        rows.append((i, "\n".join(own), "en", f"s{i % 14}"))
    spread, first = {}, {}
    for i, t, _, s in rows:
        for pos, line in enumerate(t.split("\n")):
            if len(line.strip()) >= 16:
                spread.setdefault(line.strip(), set()).add(s)
                first.setdefault(line.strip(), (i, pos))
    gone = {x for x, sites in spread.items() if len(sites) >= 10}
    expected = {i: "\n".join(x for pos, x in enumerate(t.split("\n")) if x.strip() not in gone or first[x.strip()] == (i, pos)) for i, t, *_ in rows}
    found = drop_boilerplate(docs_of(rows), **options).collect()
    assert gone and {r.doc_id: r.text for r in found} == expected


@pytest.mark.parametrize("margin", [0.25, 0.0])
def test_estimates_decide_far_from_the_threshold(docs_of, margin):
    """Sketches of 16 registers err by a quarter: lines on 300 and on 20 sites are settled by them alone, with no exact count."""
    rows = [(i, f"a line on very many sites\nand one of text {i}", "en", f"s{i}") for i in range(300)]
    rows += [(i, "a line on a few of the sites", "en", f"s{i % 20}") for i in range(300, 500)]
    found = {r.doc_id: r for r in drop_boilerplate(docs_of(rows), min_sites=100, lg_k=4, margin=margin).collect()}
    assert "very many" in found[0].text and all("very many" not in found[i].text for i in range(1, 300))
    assert all("a few" in found[i].text for i in range(300, 500))


def test_texts_without_an_id_keep_a_line_once(docs_of):
    line = "the same line on both of the sites"
    for ids in ((None, None), (1, 1), (1, 2)):
        rows = [(ids[0], line + "\nand one", "en", "a"), (ids[1], line + "\nand two", "en", "b")]
        assert sorted(r._n_removed for r in drop_boilerplate(docs_of(rows), min_sites=2).collect()) == [0, 1]


def test_boilerplate_in_odd_rows(odd, empty, docs_of):
    out = drop_boilerplate(odd, min_sites=2)
    assert out.columns == [*odd.columns, "_n_lines", "_n_removed"]
    rows = sorted(((r.doc_id or 99, r.text, r._n_removed) for r in out.collect()), key=repr)
    kept = [(i or 99, "" if i in (5, None) else t, int(i in (5, None))) for i, t, *_ in ODD]
    assert rows == sorted(kept, key=repr)
    assert line_report(empty).count() == 0
    many = docs_of([(1, "\n".join(["the same line again and again"] * 3000), "en", "a"), (2, "the same line again and again", "en", "b")])
    assert sorted((r.doc_id, r.n_removed) for r in line_report(many, min_sites=2).collect()) == [(1, 2999), (2, 1)]


def shingle_set(text, k=5):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def likeness(a, b):
    return len(a & b) / max(1, len(a | b))


def kept_by_brute_force(rows, threshold=0.8):
    sets, forest = [shingle_set(t) for _, t in rows], Forest()
    for a in range(len(rows)):
        for b in range(a):
            same = WORD.findall((rows[a][1] or "").lower()) == WORD.findall((rows[b][1] or "").lower())
            if same or likeness(sets[a], sets[b]) >= threshold:
                forest.join(a, b)
    groups = {}
    for a in range(len(rows)):
        groups.setdefault(forest.find(a), []).append(rows[a][0])
    return sorted(min(g) for g in groups.values())


def edited(rng, words, changes):
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"edit{rng.randrange(10**6)}"
    return out


def test_near_copies_down_to_the_threshold_go(docs_of):
    rng = random.Random(3)
    rows = []
    for i in range(80):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        rows.append((10 * i, " ".join(base)))
        rows += [(10 * i + c, " ".join(edited(rng, base, max(1, round(len(base) * share))))) for c, share in ((1, 0.006), (2, 0.012), (3, 0.018), (4, 0.022), (5, 0.03))]
    rng.shuffle(rows)
    sets = {i: shingle_set(t) for i, t in rows}
    bands = [sum(lo <= likeness(sets[10 * i], sets[10 * i + c]) < lo + 0.05 for i in range(80) for c in range(1, 6)) for lo in (0.75, 0.8, 0.85, 0.9)]
    assert min(bands) > 10
    assert sorted(r.doc_id for r in one_of_each(docs_of(rows).repartition(5)).collect()) == kept_by_brute_force(rows)


def test_a_large_group_is_split_without_losing_links(docs_of):
    from tripleloom.llm.simhash import likeness_links, text_classes

    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, 1 + i % 2))) for i in range(90)]
    docs = docs_of(rows)
    classes = text_classes(docs, 5)
    of = {r.cls: r.doc_id for r in classes.collect()}
    forest = Forest()
    for r in likeness_links(docs, classes, 5, 0.8, block=8).collect():
        forest.join(of[r.a], of[r.b])
    sets = [shingle_set(t) for _, t in rows]
    assert len(of) == 90 and all(forest.find(a) == forest.find(b) for a in range(90) for b in range(a) if likeness(sets[a], sets[b]) >= 0.8)


def test_near_copies_are_probed_by_their_fingerprints(docs_of):
    """Without any MinHash key, the pigeonhole search proposes what lies within its radius, and likeness decides."""
    from tripleloom.llm.simhash import NEAR, likeness_links, text_classes

    rng = random.Random(8)
    rows = []
    for i in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(150)]
        rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join(edited(rng, base, 1))), (10 * i + 2, " ".join(edited(rng, base, 12)))]
    docs = docs_of([*rows, (9000, "four words are few"), (9001, "and five words are more"), (9002, None)])
    classes = text_classes(docs, 5).withColumn("keys", F.array().cast("array<long>")).localCheckpoint()
    found = {r.doc_id: r for r in classes.collect()}
    of = {r.cls: i for i, r in found.items()}
    apart = lambda a, b: ((found[a].fp ^ found[b].fp) & (2**64 - 1)).bit_count()
    sets = {i: shingle_set(t) for i, t in rows}
    near = {(i, i + 1) for i in range(0, 600, 10) if apart(i, i + 1) <= NEAR}
    linked = {tuple(sorted((of[r.a], of[r.b]))) for r in likeness_links(docs, classes, 5, 0.8).collect()}
    assert len(near) > 55 and near <= linked and all(likeness(sets[a], sets[b]) >= 0.8 for a, b in linked)


def test_fingerprints_of_sets_equal_plain_votes():
    from tripleloom.llm._text import mix
    from tripleloom.llm.likeness import set_fingerprints

    rng = np.random.default_rng(2)
    sizes = [0, 1, 2, 0, 3, 4, 100, 70_000, 5, 0]
    first = np.cumsum([0, *sizes])
    hashes = rng.integers(0, 2**63, first[-1], dtype=np.uint64)
    votes = [mix(hashes[a:b]).tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    expected = [sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in v) + (v[0] >> k & 1) > len(v)) if v else 0 for v in votes]
    assert set_fingerprints(hashes, first).tolist() == expected


def test_texts_under_the_threshold_stay(docs_of):
    rng = random.Random(6)
    rows = [(0, ""), (1, None), (2, "two words"), (3, "Two  words"), (4, "other words"), (5, "words two")]
    rows += [(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(6))) for i in range(100, 1600)]
    for i in range(2000, 2400, 2):
        base = [f"w{rng.randrange(3000)}" for _ in range(150)]
        rows += [(i, " ".join(base)), (i + 1, " ".join(edited(rng, base, 5)))]
    kept = {r.doc_id for r in one_of_each(docs_of(rows)).collect()}
    sets = dict((i, shingle_set(t)) for i, t in rows)
    apart = [i for i in range(2001, 2400, 2) if likeness(sets[i - 1], sets[i]) < 0.8]
    assert len(apart) > 150 and kept == {0, 2, 4, 5, *range(100, 1600), *range(2000, 2400, 2), *apart}


@pytest.mark.parametrize("most", [100_000, 2])
def test_frequent_keys_are_joined_apart(spark, most, monkeypatch):
    monkeypatch.setattr(_session, "LEAST_HOT", 3)
    monkeypatch.setattr(_session, "MOST_HOT", most)
    keys = [1] * 50 + [2] * 3 + [3] * 4 + [4, 5]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    known = spark.createDataFrame([(k, k * 10, keys.count(k)) for k in (1, 2, 3, 5)], "k long, v long, n long")
    found = _session.join_counted(rows, known, "k", len(keys)).collect()
    assert sorted((r.k, r.i, r.v) for r in found) == [(k, i, k * 10) for k, i in sorted((k, i) for i, k in enumerate(keys) if k != 4)]
