"""What keeps the queries' work in proportion to their input."""

from hashlib import md5

import pytest
from pyspark.sql import functions as F

from tripleloom import queries as Q
from tripleloom.operators import cardinality as C
from tripleloom.operators import statistics as S
from tripleloom.plans import bgp as B
from tripleloom.plans import table as T
from tripleloom.sources import triples as G

CYCLE = B.parse_all(["?o <o_customer> ?c", "?c <c_nation> ?n", "?s <s_nation> ?n", "?o <has_supplier> ?s"])


def test_a_cycle_is_not_closed_through_a_hub():
    """Two hundred orders and suppliers of one nation: no factor holds all pairs of them."""
    sizes = {0: (9000, {"?o": 9000, "?c": 900}), 1: (900, {"?c": 900, "?n": 5}), 2: (60, {"?s": 60, "?n": 5}), 3: (36000, {"?o": 9000, "?s": 60})}
    plan = B.contraction(CYCLE, sizes, [(0, 1, 2, 3), (0, 1, 2), (1, 2)])
    assert all(keep != {"?o", "?s"} for members, keep in plan if len(members) > 1)
    assert all(keep <= {"?n"} for members, keep in plan if len(members) > 1 and set(members) <= {0, 1, 2} and 0 in members and 2 in members)


def test_smaller_sets_are_summed_from_what_larger_ones_keep():
    """No join is there for a set whose bindings a larger set is counted from, and no product of orders and parts."""
    sizes = {0: (36000, {"?o": 9000, "?p": 1200}), 1: (1200, {"?p": 1200, "?b": 25}), 2: (9000, {"?o": 9000, "?c": 900}), 3: (900, {"?c": 900, "?n": 25}), 4: (25, {"?n": 25, "?r": 5})}
    goals = sorted({c for w in C.subsets(5) for c in B.components(Q.SNOWFLAKE, w)})
    plan = B.contraction(Q.SNOWFLAKE, sizes, goals)
    joins = [f for f, made_from in plan.items() if made_from and len(made_from) == 2]
    assert all((g, frozenset()) in plan for g in goals)
    assert len([f for f in joins if 0 in f[0] and 2 in f[0] and 3 not in f[0]]) == 2 and len({f[0] for f in joins}) == len(joins)
    assert ((0, 2), frozenset({"?p"})) not in plan and plan[(0, 1, 2), frozenset()] == (((0, 1, 2), frozenset({"?c"})),)


@pytest.mark.parametrize("few", [0, 100_000])
def test_counts_of_all_sets_equal_solutions(spark, few, monkeypatch):
    monkeypatch.setattr(B, "SMALL", few)  # 0: every factor of several uses is written, none is broadcast
    rows = {(f"o{i}", "<has_part>", f"p{(i * k) % 11}") for i in range(30) for k in (1, 2, 3)} | {(f"p{i}", "<p_brand>", f"b{i % 3}") for i in range(9)}
    rows |= {(f"o{i}", "<o_customer>", f"c{i % 7}") for i in range(25)} | {(f"c{i}", "<c_nation>", f"n{i % 4}") for i in range(6)} | {(f"n{i}", "<n_region>", f"r{i % 2}") for i in range(3)}
    kg = spark.createDataFrame(sorted(rows), "s string, p string, o string")
    goals = sorted({c for w in C.subsets(5) for c in B.components(Q.SNOWFLAKE, w)})
    found = {r.mask: r.cnt for r in C.connected_counts(kg, Q.SNOWFLAKE, goals).collect()}
    assert found == {sum(1 << i for i in g): B.solve(kg, [Q.SNOWFLAKE[i] for i in g]).count() for g in goals}


@pytest.mark.parametrize("goal", [(0, 1, 2, 3), (0, 1, 2), (0, 3)])
def test_counts_of_a_cycle(spark, goal):
    rows = [(f"o{i}", "<o_customer>", f"c{i % 7}") for i in range(40)] + [(f"c{i}", "<c_nation>", f"n{i % 2}") for i in range(7)]
    rows += [(f"s{i}", "<s_nation>", f"n{i % 2}") for i in range(9)] + [(f"o{i}", "<has_supplier>", f"s{(i * k) % 9}") for i in range(40) for k in (1, 2)]
    kg = spark.createDataFrame(sorted(set(rows)), "s string, p string, o string")
    patterns = [CYCLE[i] for i in goal]
    expected = B.solve(kg, patterns).count()
    assert B.count(kg, patterns).first().cnt == expected
    assert int(C.subset_cards(kg, CYCLE, [goal]).first().card) == expected


def test_parts_of_a_graph_grow_with_its_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "ROWS_A_TASK", 100)
    spark.range(1000).select(F.col("id").alias("c_custkey"), (F.col("id") % 3).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    kg = G.graph_of(spark, str(tmp_path), ["c_nation"])
    used = kg.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in used) == 1000 and len(used) == 10


def order_of_draws(seed, pool, *key):
    return sorted(pool, key=lambda i: (md5("|".join(map(str, (seed, *key, i))).encode()).hexdigest(), i))


def family_of(query, names, siblings=8, alternatives=2, cartesian=2, randoms=2):
    """``T.family`` of one query, in plain Python."""
    n = len(names)
    overlaps = lambda i, order: bool(names[i] & set().union(*(names[j] for j in order)))

    def completed(order):
        while len(order) < n:
            left = [i for i in range(n) if i not in order]
            order = [*order, order_of_draws(0, [i for i in left if overlaps(i, order)] or left, query)[0]]
        return order

    crossed = lambda order: sum(not overlaps(i, order[:k]) for k, i in enumerate(order) if k)
    label = list(range(n))
    for _ in range(n):
        label = [min(label[j] for j in range(n) if j == i or names[i] & names[j]) for i in range(n)]
    least, base = len(set(label)) - 1, completed([order_of_draws(1, range(n), query)[0]])
    kinds = {"base": [base], "sibling": [], "cartesian": [], "random": [order_of_draws(s, range(n), query) for s in range(5, 5 + randoms)]}
    for near, s, each, more, most, kind in ((True, 2, alternatives, 0, siblings, "sibling"), (False, 3, 1, 1, cartesian, "cartesian")):
        found = []
        for k in range(1, n):
            pool = [i for i in range(n) if i not in base[:k] and overlaps(i, base[:k]) == near and not (near and i == base[k])]
            for i in order_of_draws(s, pool, query, k)[:each]:
                order = completed([*base[:k], i])
                if crossed(order) == least + more:
                    found.append((md5(f"4|{query}|{k}|{i}".encode()).hexdigest(), order))
        kinds[kind] = [order for _, order in sorted(found)[:most]]
    out = {}
    for kind, orders in kinds.items():
        for order in orders:
            out.setdefault(tuple(order), kind)
    return {(query, kind, order) for order, kind in out.items()}


def test_families_equal_plain_python(spark):
    shapes = [[*"abc"], ["ab", "bc", "cd", "da"], ["ab", "bc", "x", "xy"], ["a"], ["ab", "a", "b", "cd", "d"]]
    queries = [(q, [(*(f"?{v}" for v in (x + x)[:2]), "c") for x in shapes[q % 5]]) for q in range(40)]
    df = spark.createDataFrame(queries, "query_id long, triples array<struct<s:string,p:string,o:string>>")
    expected = set().union(*(family_of(q, [{t for t in x if t[0] == "?"} for x in triples]) for q, triples in queries))
    assert {(r.query_id, r.kind, tuple(r.ord)) for r in T.family(df).collect()} == expected


def test_many_queries_of_a_few_shapes_are_worked_out_once_a_shape(spark):
    df = spark.range(2000).select(F.col("id").alias("query_id"), F.array((F.col("id") % 3).cast("string")).alias("names"))
    seen = []
    found = T.by_kind(df, {"names": F.col("names")}, lambda kinds: (seen.append(kinds.count()), kinds.select("names", F.explode(F.array(F.lit(1), F.lit(2))).alias("x")))[1])
    assert seen == [3] and found.groupBy("names").count().count() == 3 and found.count() == 4000


def test_few_bytes_of_many_queries_are_many_tasks(spark, tmp_path):
    spark.range(20_000).select(F.col("id").alias("c_custkey"), (F.col("id") % 3).cast("int").alias("c_nationkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert Q.workload(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().count() == 4


def test_degrees_without_the_factor_graph(spark):
    kg = spark.createDataFrame([("a", "p", "b"), ("b", "p", "a"), ("a b", "c", "d"), ("a", "b c", "d"), ("p", "q", "p")], "s string, p string, o string")
    assert sorted(S.factor_degrees(kg).collect()) == sorted(S.degrees(S.factor_graph(kg)).collect())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_nodes_of_triples_are_shuffled_only_where_they_may_meet(spark, tmp_path, monkeypatch, kind):
    """Whole numbers hold no space, so a triple's node is its own; of texts, two triples may share one."""
    monkeypatch.setattr(G, "MAPPING", {p: x for p, x in G.MAPPING.items() if x[0] == "customer"})
    rows = [(i, i % 3, "A B" if i % 2 else "C") for i in range(40)] + [(1, 1, "A B"), (41, None, "C")]
    if kind == "string":  # both customers' c_nation reads the same
        rows = [("1", "2> <c_nation> <nation/3", "C"), ("1> <c_nation> <nation/2", "3", "C")]
    value = "long" if kind == "long" else "string"
    spark.createDataFrame(rows, f"c_custkey {kind}, c_nationkey {value}, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    found = Q.factor_graph_degree(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    grouped = next(i for i, line in enumerate(plan) if "Aggregate [" in line and "degree" in line)
    made = next(i for i, line in enumerate(plan) if i > grouped and "Generate explode" in line)
    assert any("sha1" in line for line in plan[grouped : made + 1]) == (kind == "string")
    expected = S.degrees(S.factor_graph(G.graph_of(spark, str(tmp_path)))).collect()
    assert sorted(found.collect()) == sorted(expected)
    assert {r.degree for r in expected if r.src.startswith("t:")} == ({3} if kind == "long" else {3, 6})


def test_a_subject_s_triples_lie_together_but_a_hub_s(spark, tmp_path, monkeypatch):
    """Terms are counted before they are shuffled, which is of use only where a term's triples meet in few tasks."""
    monkeypatch.setattr(G, "ROWS_A_TASK", 100)
    monkeypatch.setattr(G, "MAPPING", {"has_part": G.MAPPING["has_part"]})
    ids = F.col("id")
    rows = spark.range(3000).select(F.when(ids < 1000, 350).otherwise(ids % 700).alias("l_orderkey"), ids.alias("l_partkey"))
    rows.union(rows).write.parquet(f"{tmp_path}/lineitem.parquet")
    tasks = {ranges: G.graph_of(spark, str(tmp_path), ranges=ranges).groupBy("s", F.spark_partition_id().alias("task")).count().collect() for ranges in (False, True)}
    assert all(len({r.s for r in found}) == 700 and sum(r["count"] for r in found) == 3000 for found in tasks.values())
    assert len(tasks[True]) < 700 + 2 * 60 and len(tasks[False]) > 1500 and sum(r.s == "<order/350>" for r in tasks[True]) > 10
    for query in (Q.factor_graph_degree, Q.term_occurrences, Q.role_occurrences, Q.node_features):
        assert "rangepartitioning(l_orderkey" in query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_a_small_frontier_leaves_the_edges_where_they_are(spark):
    edges = spark.range(5000).select((F.col("id") % 50).cast("string").alias("src"), F.col("id").cast("string").alias("dst"), F.lit("r").alias("role"))
    seeds = spark.createDataFrame([("1",), ("2",)], "node string")
    found = S.neighbourhood(edges, seeds, 2).collect()
    assert {(r.src, r.hop) for r in found} == {("1", 1), ("2", 1)} and len(found) == 200


def test_results_are_dealt_by_query_in_parts_that_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "ROWS_A_TASK", 100)
    line = [(F.col("id") / 2).cast("long").alias("l_orderkey"), F.lit("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus"), F.lit(2.0).alias("l_quantity"), F.col("id").cast("double").alias("l_extendedprice")]
    spark.range(1000).select(*line).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = Q.results(spark, str(tmp_path)).select("*", F.spark_partition_id().alias("task")).collect()
    assert len(found) == 500 and len({r.task for r in found}) == 10 and all(r.predicted_cost == 3600 and r.real_cost == 2 * r.query_id for r in found)


def test_steps_of_plans_stay_where_they_are(spark):
    """Many plans have few predicates, so their steps do not meet by predicate whatever the session broadcasts itself."""
    orders = spark.range(300).select(F.col("id").alias("query_id"), F.lit(0).alias("plan_id"), F.expr("array(struct('?a' AS s, 'p' AS p, '?b' AS o), struct('?b' AS s, 'q' AS p, 'x' AS o))").alias("triples"), F.array(F.lit(0), F.lit(1)).alias("ord"))
    kg = spark.createDataFrame([("a", "p", "b"), ("a", "p", "c"), ("b", "q", "x")], "s string, p string, o string")
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = C.fanout_bounds(orders, S.predicate_stats(kg).localCheckpoint())
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {round(r.log_bound, 6) for r in found.collect()} == {0.693147} and found.count() == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_subjects_are_counted_in_parts_that_grow(spark, tmp_path, monkeypatch):
    """The session's four shuffle partitions do not bound the tasks; statistics are the same, with frequent subjects and objects."""
    monkeypatch.setattr(G, "ROWS_A_TASK", 100)
    line = [(F.col("id") % 700).alias("l_orderkey"), F.col("id").alias("l_partkey"), (F.col("id") % 2).alias("l_suppkey")]
    spark.range(3000).select(*line).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(G, "MAPPING", {p: x for p, x in G.MAPPING.items() if x[0] == "lineitem"})
    used, real = [], S.predicate_degrees
    monkeypatch.setattr(S, "predicate_degrees", lambda kg, column, parts=None: (used.append((column, parts)), real(kg, column, parts))[1])
    found = {r.p: tuple(r)[1:] for r in Q.predicate_stats(spark, str(tmp_path)).collect()}
    assert found == {"<has_part>": (3000, 700, 3000, 5, 1), "<has_supplier>": (700, 700, 2, 1, 350)} and dict(used) == {"s": 20, "o": None}
    assert real(G.graph_of(spark, str(tmp_path)), "s", 20).groupBy(F.spark_partition_id()).count().count() == 20


def test_constants_are_counted_without_other_terms(spark, tmp_path, monkeypatch):
    """Other terms are gone before roles are grouped, and subjects of the bound predicates are counted in parts that grow."""
    monkeypatch.setattr(G, "ROWS_A_TASK", 100)
    key = lambda n, at, other, m: spark.range(n).select(F.col("id").alias(at), (F.col("id") % m).alias(other))
    for name, df in {"orders": key(3000, "o_orderkey", "o_custkey", 700), "customer": key(700, "c_custkey", "c_nationkey", 25), "nation": key(25, "n_nationkey", "n_regionkey", 5)}.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(G, "MAPPING", {p: G.MAPPING[p] for p in Q.predicates(Q.PATH)})
    used, real = [], S.predicate_degrees
    monkeypatch.setattr(S, "predicate_degrees", lambda kg, column, parts=None: (used.append((column, parts)), real(kg, column, parts))[1])
    found = Q.bound_terms(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {("<o_customer>", 0, 3000, 0, 1, 5), ("<c_nation>", 0, 700, 0, 1, 28), ("<n_region>", 0, 25, 0, 1, 5), ("<region/1>", 0, 0, 5, 0, 0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    grouped = next(i for i, line in enumerate(plan) if "Aggregate [" in line and "n_s" in line)
    made = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    assert any("Filter" in line and "<region/1>" in line for line in plan[grouped:made]) and dict(used) == {"s": 13, "o": None}
