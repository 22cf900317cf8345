"""Graph operators on graphs of a few triples, against brute force."""

import math
import random
from itertools import permutations, product

import pytest
from pyspark.sql import functions as F

from tripleloom.operators import cardinality as C
from tripleloom.operators import features as X
from tripleloom.operators import search
from tripleloom.operators import statistics as S
from tripleloom.plans import bgp as B
from tripleloom.plans import orders as O
from tripleloom.plans import table as T
from tripleloom.sources.triples import read_graph, read_ntriples, write_graph

TRIPLES = [
    ("a", "knows", "b"), ("b", "knows", "c"), ("c", "knows", "a"), ("a", "knows", "a"), ("a", "likes", "x"),
    ("b", "likes", "x"), ("c", "likes", "y"), ("x", "type", "thing"), ("y", "type", "thing"), ("d", "knows", "b"),
]


@pytest.fixture(scope="module")
def kg(spark):
    return spark.createDataFrame(TRIPLES, "s string, p string, o string").persist()


def solutions(patterns):
    out = []
    for choice in product(TRIPLES, repeat=len(patterns)):
        bound = {}
        if all((bound.setdefault(t, v) == v if t.startswith("?") else t == v) for p, triple in zip(patterns, choice, strict=True) for t, v in zip((p.s, p.p, p.o), triple, strict=True)):
            out.append(bound)
    return out


BGPS = [
    ["?x knows ?y"],
    ["?x knows ?x"],
    ["?x ?p thing"],
    ["a knows b"],
    ["a knows z"],
    ["?x knows ?y", "?y likes ?z", "?z type thing"],
    ["?x knows ?y", "?y knows ?z", "?z knows ?x"],
    ["?x likes ?y", "?u likes ?v"],
    ["?x likes x", "?u knows x", "?x knows ?u"],
]


@pytest.mark.parametrize("texts", BGPS)
def test_counts_and_solutions(kg, texts):
    patterns = B.parse_all(texts)
    expected = solutions(patterns)
    for order in permutations(range(len(patterns))):
        assert B.solve(kg, patterns, order).count() == len(expected)
    card = C.subset_cards(kg, patterns, [tuple(range(len(patterns)))]).first().card
    assert int(card) == len(expected)


def test_costs_agree_with_executed_prefixes(kg):
    patterns = B.parse_all(["?x knows ?y", "?y likes ?z", "?z type ?t", "?u likes ?v"])
    cards = C.subset_cards(kg, patterns)
    costs = {tuple(r.ord): int(r.c_out) for r in C.c_out(C.all_orders(kg.sparkSession, 4), cards).collect()}
    for order in random.Random(0).sample(sorted(costs), 6):
        assert costs[order] == sum(len(solutions([patterns[i] for i in order[:k]])) for k in range(2, 5))
    best = min(costs.values())
    assert C.best(C.c_out(C.all_orders(kg.sparkSession, 4), cards)).first().c_out == best
    cards = cards.select(F.lit(1).alias("query_id"), "mask", "card").persist()
    first = min(o for o, c in costs.items() if c == best)
    assert [(tuple(r.ord), int(r.cost)) for r in search.dynamic(cards).collect()] == [(first, best)]
    assert min((int(r.cost), tuple(r.ord)) for r in search.beam(cards, 24).collect()) == (best, first)
    assert max(int(r.cost) for r in search.beam(cards, 24, worst=True).collect()) == max(costs.values())
    greedy = search.beam(cards, 1).first()
    sizes = {r.mask: int(r.card) for r in cards.collect()}
    order = [min(range(4), key=lambda i: (sizes[1 << i], i))]
    while len(order) < 4:
        order.append(min((i for i in range(4) if i not in order), key=lambda i: (sizes[sum(1 << j for j in [*order, i])], i)))
    assert greedy.ord == order and int(greedy.cost) == costs[tuple(order)]


def test_searches_answer_each_query_alone(spark):
    rng = random.Random(4)
    rows = [(q, m, rng.randrange(1, 1000)) for q, n in ((1, 3), (2, 4), (3, 1)) for m in range(1, 1 << n)]
    rows = [r for r in rows if r[:2] != (2, 5)]  # a set of unknown size is never taken
    cards = spark.createDataFrame(rows, "query_id long, mask int, card long").withColumn("card", F.col("card").cast("decimal(38,0)"))
    known = {r[:2]: r[2] for r in rows}
    for q, n in ((1, 3), (2, 4), (3, 1)):
        best = None
        for order in permutations(range(n)):
            masks = [sum(1 << i for i in order[:k]) for k in range(1, n + 1)]
            if all((q, m) in known for m in masks):
                found = (sum(known[q, m] for m in masks[1:]), order)
                best = found if best is None else min(best, found)
        assert [(int(r.cost), tuple(r.ord)) for r in search.dynamic(cards).where(F.col("query_id") == q).collect()] == [best]


def test_sets_grow_from_connected_ones():
    patterns = B.parse_all(["?a p ?b", "?b p ?c", "?c p ?d", "?d p ?e", "?e p ?f", "?f p ?g"])
    grown = C.grown_from(patterns, [tuple(range(6)), (1, 2)])
    assert len(grown) <= 7  # linear in the wanted sets' sizes
    for members, i in grown.items():
        assert i is None if len(members) == 1 else tuple(j for j in members if j != i) in grown


def test_cache_counts_only_what_is_new(kg):
    patterns = B.parse_all(["?x knows ?y", "?y likes ?z"])
    first = C.remember(None, C.component_counts(kg, patterns, [(0,), (1,)]))
    both = C.component_counts(kg, patterns, [(0, 1), (0,)], first)
    assert {r["mask"]: r["cnt"] for r in both.collect()} == {1: 5, 3: len(solutions(patterns))}
    assert C.remember(first, both).count() == 3


def test_unknown_size_is_censored(spark):
    cards = spark.createDataFrame([(1, 2), (2, 3)], "mask int, card int").select("mask", F.col("card").cast("decimal(38,0)"))
    assert all(r.censored for r in C.c_out(C.all_orders(spark, 2), cards).collect())


def test_orders():
    patterns = B.parse_all(["?x knows ?y", "?y likes ?z", "?u likes <c>", "<c> type ?t", "?z type ?t"])
    assert B.components(patterns) == [(0, 1, 3, 4), (2,)] and B.connected_order(patterns) is None
    rest = [patterns[i] for i in (0, 1, 3, 4)]
    assert B.cartesian_joins(rest, B.connected_order(rest)) == 0
    for kind, order in O.siblings(patterns):
        assert sorted(order) == list(range(5)) and B.cartesian_joins(patterns, order) == 1 + (kind == "cartesian")
    for seed in range(20):
        assert sorted(O.leaves(O.random_bushy(patterns, seed))) == list(range(5))
        assert B.cartesian_joins(rest, O.random_connected(rest, seed)) == 0
        bad = O.corrupted(patterns, seed)
        assert not patterns[bad[0]].variables & patterns[bad[1]].variables
        order = random.Random(seed).sample(range(5), 5)
        assert B.canonical(O.order_of(O.adjacency(order), 5)) == B.canonical(order)
    assert O.same_tree(((0, 1), 2), (2, (1, 0))) and not O.same_tree(((0, 1), 2), ((0, 2), 1))
    assert O.shown(O.left_deep([1, 0, 2])) == "Join(Join(1, 0), 2)"
    assert B.problems([0, 0, 3], 3) == {"missing": [1, 2], "repeated": [0], "unknown": [3]}
    with pytest.raises(ValueError):
        B.parse("?x knows")
    assert B.parse('<a> <b> "c d e" .').o == '"c d e"'


def queries_of(spark, texts):
    rows = [(k, [(p.s, p.p, p.o) for p in B.parse_all(t)]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "query_id long, triples array<struct<s:string,p:string,o:string>>")


CHAINS = [
    ["?x knows ?y", "?y likes ?z", "?u likes <c>", "<c> type ?t", "?z type ?t"],
    ["?x knows ?y"],
    ["?x knows ?x", "?x likes ?y", "?y type thing", "?z knows ?x"],
    ["?a p ?b", "?c p ?d", "?b p ?e", "?d p ?f", "?g p ?e"],
]


def test_bounds_never_underestimate(kg, spark):
    patterns = B.parse_all(["?x knows ?y", "?y likes ?z", "?z type ?t"])
    orders = queries_of(spark, [[str(p) for p in patterns]]).crossJoin(C.all_orders(spark, 3).withColumnRenamed("order_id", "plan_id"))
    found = C.fanout_bounds(orders, S.predicate_stats(kg)).collect()
    assert len(found) == 6 and all(r.log_bound >= math.log(len(solutions(patterns))) - 1e-9 for r in found)


def test_row_local_expressions_equal_plain_python(spark):
    queries = queries_of(spark, CHAINS)
    names = T.names_of(F.col("triples"))
    found = queries.select("query_id", T.connected_order(F.col("triples")).alias("c"), T.component_labels(names).alias("l"), T.shared_counts(names).alias("x")).collect()
    for r in found:
        patterns = B.parse_all(CHAINS[r.query_id])
        assert r.c == B.connected_order(patterns)
        assert r.l == [next(c[0] for c in B.components(patterns) if i in c) for i in range(len(patterns))]
        share = B.sharing(patterns)
        assert {(x.i, x.j): x.n for x in r.x} == {(i, j): n for i, row in enumerate(share) for j, n in enumerate(row) if n}
    orders = [(q, list(o)) for q, t in enumerate(CHAINS) for o in random.Random(q).sample(list(permutations(range(len(t)))), min(20, len(list(permutations(range(len(t)))))))]
    rows = queries.join(spark.createDataFrame(orders, "query_id long, ord array<int>"), "query_id")
    edges = T.left_deep_edges(F.col("ord"))
    for r in rows.select("query_id", "ord", T.cartesian_joins(F.col("ord"), names).alias("n"), T.tree_cartesian_joins(edges, names).alias("t"), edges.alias("e"), T.canonical(F.col("ord")).alias("c")).collect():
        patterns = B.parse_all(CHAINS[r.query_id])
        assert r.n == r.t == B.cartesian_joins(patterns, r.ord)
        assert [(e.child, e.parent) for e in r.e] == O.adjacency(r.ord) or sorted((e.child, e.parent) for e in r.e) == sorted(O.adjacency(r.ord))
        assert tuple(r.c) == B.canonical(r.ord)
    plans = spark.createDataFrame([([0, 0, 3], 3), ([1, 2], 3), ([2, 1, 0], 3)], "ord array<int>, n int").select(T.problems(F.col("ord"), F.col("n")).alias("x")).collect()
    assert [r.x.asDict() for r in plans] == [B.problems(o, 3) for o in ([0, 0, 3], [1, 2], [2, 1, 0])]


def test_trees_of_any_shape(spark):
    queries = queries_of(spark, [["?a p ?b", "?c p ?d", "?b p ?c", "?e p ?f"]])
    plans = [
        ([(0, 4), (1, 4), (2, 5), (3, 5), (4, 6), (5, 6)], 2),  # (0 1) and (2 3) share nothing, their joins do
        ([(0, 4), (2, 4), (4, 5), (1, 5), (5, 6), (3, 6)], 1),
        ([(0, 4), (2, 4), (4, 5), (1, 5), (3, 6)], 0),  # a join of one side: a tree all the same
        ([(0, 4), (2, 4), (6, 5), (1, 5), (5, 6), (3, 6)], -1),  # a cycle
        ([(0, 4), (2, 4)], -1),
    ]
    rows = spark.createDataFrame([(0, k, p) for k, (p, _) in enumerate(plans)], "query_id long, plan_id int, edges array<struct<child:int,parent:int>>").join(queries, "query_id")
    found = {r.plan_id: r for r in rows.select("plan_id", T.tree_cartesian_joins(F.col("edges"), T.names_of(F.col("triples"))).alias("n"), T.masks_of(T.tree_patterns(F.col("edges"), F.lit(4))).alias("m")).collect()}
    assert [found[k].n for k in range(5)] == [n for _, n in plans]
    assert found[0].m == [3, 12, 15] and found[1].m == [5, 7, 15]
    cards = spark.createDataFrame([(3, 10), (12, 20), (15, 5), (5, 7), (7, None)], "mask int, card int").withColumn("card", F.col("card").cast("decimal(38,0)"))
    costs = {r.plan_id: (r.c_out, r.censored) for r in C.tree_costs(rows.select("plan_id", "edges"), cards, 4).collect()}
    assert costs[0] == (35, False) and costs[1] == (12, True) and costs[3] == (None, False)


def test_families(spark):
    found = T.family(queries_of(spark, CHAINS), siblings=4, alternatives=2, cartesian=2, randoms=2, seed=3).collect()
    assert len({(r.query_id, tuple(r.ord)) for r in found}) == len(found)
    for q, texts in enumerate(CHAINS):
        patterns = B.parse_all(texts)
        least = len(B.components(patterns)) - 1
        own = [r for r in found if r.query_id == q]
        base = next(r.ord for r in own if r.kind == "base")
        assert B.cartesian_joins(patterns, base) == least
        assert sum(r.kind == "sibling" for r in own) <= 4 and sum(r.kind == "cartesian" for r in own) <= 2
        for r in own:
            assert sorted(r.ord) == list(range(len(patterns)))
            if r.kind != "random":
                assert B.cartesian_joins(patterns, r.ord) == least + (r.kind == "cartesian")
    assert {r.kind for r in found} == {"base", "sibling", "cartesian", "random"}


def test_broken_plans_differ_and_cost_nothing_finite(spark):
    orders = [(q, k, list(o)) for q in range(3) for k, o in enumerate(permutations(range(4)))]
    plans = spark.createDataFrame(orders, "query_id int, plan_id int, ord array<int>").select("query_id", "plan_id", F.size("ord").alias("n"), T.left_deep_edges(F.col("ord")).alias("edges"))
    before = {(r.query_id, r.plan_id): {tuple(e) for e in r.edges} for r in plans.collect()}
    sizes = set()
    for r in T.broken(plans).collect():
        own, new = before[r.query_id, r.plan_id], {tuple(e) for e in r.edges}
        assert new != own and len(own - new) <= 3 and len(new - own) <= 3 and len(new) == len(r.edges) and math.isinf(r.y)
        assert all(0 <= x < 7 for e in new for x in e)
        sizes.add((len(own - new), len(new - own)))
    assert len(sizes) > 5


def test_features_with_defaults(spark):
    queries = queries_of(spark, [["?x knows <a>", "?y likes ?x", "<b> knows ?z"]])
    vectors = spark.createDataFrame([("<a>", [1.0, 2.0]), ("<unused>", [9.0, 9.0])], "term string, embedding array<double>")
    counts = spark.createDataFrame([("<a>", 5), ("knows", 7)], "term string, n long")
    found = {(r.pattern, r.slot): (r.variable, r.embedding, r.n) for r in X.pattern_features(queries, vectors, counts, 2).collect()}
    assert found[0, 0] == found[1, 2] == (0, [1.0, 1.0], 0) and found[1, 0] == (1, [1.0, 1.0], 0) and found[2, 2] == (2, [1.0, 1.0], 0)
    assert found[0, 2] == (0, [1.0, 2.0], 5) and found[0, 1] == (0, [0.0, 0.0], 7) and found[2, 0] == (0, [0.0, 0.0], 1)


def test_hubs_are_capped_in_parts(spark):
    edges = spark.createDataFrame([("hub", f"d{i}", "r") for i in range(500)] + [("x", "y", "r")], "src string, dst string, role string")
    whole, parted = ({(r.src, r.dst, r.weight) for r in S.capped(edges, 7, 3, size).collect()} for size in (10_000, 50))
    assert whole == parted and len(whole) == 8 and {w for s, _, w in whole if s == "hub"} == {500 / 7}


def test_failed_counts_are_remembered(kg):
    patterns = B.parse_all(["?x knows ?y", "?y likes ?z"])
    failed = kg.sparkSession.createDataFrame([(B.key_of(patterns, (0, 1)), -1)], "key string, cnt long")
    cards = {r.mask: r.card for r in C.subset_cards(kg, patterns, cache=failed).collect()}
    assert cards == {1: 5, 2: 3, 3: None}


def test_files(spark, kg, tmp_path):
    (tmp_path / "g.nt").write_text('# comment\n\n<a> <b> <c> .\n<a> <b> <c> .\n<a> <b> "two words. really" .\nbroken\n')
    assert sorted(map(tuple, read_ntriples(spark, str(tmp_path / "g.nt")).collect())) == [("<a>", "<b>", '"two words. really"'), ("<a>", "<b>", "<c>")]
    write_graph(kg, str(tmp_path / "kg"))
    stored = read_graph(spark, str(tmp_path / "kg"))
    assert sorted(map(tuple, stored.collect())) == sorted(TRIPLES)
    assert "PartitionFilters: [isnotnull(p" in B.scan(stored, B.parse("?x likes ?y"))._jdf.queryExecution().toString()


def test_statistics(kg):
    stats = {r["p"]: r for r in S.predicate_stats(kg).collect()}
    assert stats["knows"][1:] == (5, 4, 3, 2, 2)
    assert {r.term: r.n for r in S.term_occurrences(kg).collect()}["a"] == 5
    edges = S.factor_graph(kg)
    assert edges.count() == 6 * len(TRIPLES)
    near = S.neighbourhood(edges, kg.sparkSession.createDataFrame([("e:a",)], "node string"), 2, cap=2, seed=1)
    assert near.groupBy("src").count().agg(F.max("count")).first()[0] <= 2 and near.agg(F.min("weight")).first()[0] >= 1.0
    walks = S.random_walks(kg, depth=3, per_node=2, seed=1).collect()
    known = set(TRIPLES)
    assert len(walks) == 2 * len({t[0] for t in TRIPLES})
    assert all((w.path[i], w.path[i + 1], w.path[i + 2]) in known for w in walks for i in range(0, len(w.path) - 2, 2))
    stored = S.walk_embeddings(S.random_walks(kg, depth=3, per_node=3, seed=1), size=4, rounds=1)
    assert {r.word for r in stored.getVectors().collect()} >= {t[0] for t in TRIPLES}


def test_factor_graph_is_stored_by_source(kg, tmp_path):
    edges = S.factor_graph(kg)
    S.write_factor_graph(edges, str(tmp_path / "f"))
    assert kg.sparkSession.read.parquet(str(tmp_path / "f")).exceptAll(edges).count() == 0
