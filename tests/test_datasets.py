"""Data sets of queries and plans, and analytics, on small tables."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tripleloom.functions import metrics as M
from tripleloom.operators import analytics as A
from tripleloom.operators import datasets as D
from tripleloom.operators.pairs import pairs_within


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("q") / "queries.json"
    rows = [
        {"triples": [["?x", "<p>", "?y"], ["?y", "<q>", "<a>", "."]], "y": 4},
        {"triples": [["?x", "<p>", "?y"], ["?y", "<q>", "<a>"]], "y": 9},
        {"triples": [["?x", "?p", "?y"], ["?y", "<q>", "<a>"]], "y": 3},
        {"triples": [["<s>", "<p>", "<o>"]], "y": 0},
        {"triples": [["<s>", "<p>", "?z"]]},
    ]
    path.write_text(json.dumps(rows))
    return D.read_queries(spark, str(path)).persist()


@pytest.fixture(scope="module")
def plans(spark):
    rows = [(1, "a", 5.0, 1.0, 0), (1, "b", 50.0, 3.0, 1), (1, "c", 5.0, 2.0, 0), (2, "a", 7.0, 1.0, 0), (3, "a", 2.0, 5.0, 1), (3, "b", 1.0, 6.0, 1), (4, "a", float("inf"), 0.0, 0), (4, "b", -1.0, 0.0, 0)]
    return spark.createDataFrame(rows, "group_id long, plan_id string, y double, prediction double, cartesian int")


def test_queries(stored):
    assert stored.count() == 5 and D.usable(stored).count() == 2
    assert D.at_most_uris(stored, 1).count() == 0 and D.at_most_uris(stored, 2).count() == 4
    assert D.distinct_queries(stored).count() == 4
    atoms = D.bound_atoms(stored.where("y = 3")).collect()
    assert sorted((r.pattern, r.slot, r.kind, r.term) for r in atoms) == [(1, 1, "rel", "<q>"), (1, 2, "ent", "<a>")]
    assert {(r.i, r.j, r.n) for r in D.shared_variables(stored.where("y = 4")).collect()} == {(0, 1, 1), (1, 0, 1)}
    assert [r.query_id for r in D.seeded(stored, 3, 5).collect()] == [r.query_id for r in D.seeded(stored, 3, 5).collect()]


def test_plans(plans):
    assert D.with_costs(plans).count() == 6
    assert {r.group_id for r in D.rank_groups(D.with_costs(plans)).collect()} == {1, 3}
    parts = [D.split(plans, 3, k) for k in range(3)]
    assert sum(p.where("held").count() for p in parts) == plans.count()
    assert all(p.where("held").select("group_id").intersect(p.where("NOT held").select("group_id")).count() == 0 for p in parts)
    loss = {r.group_id: r for r in D.ranking_loss(D.with_costs(plans)).collect()}
    assert set(loss) == {1, 3} and loss[1].pairs == 2 and loss[1].accuracy == 1.0 and loss[3].accuracy == 0.0
    assert loss[3].loss == pytest.approx(math.log1p(math.exp(1.0)))
    assert {(r.group_id, r.good, r.bad) for r in D.contrast(D.with_costs(plans)).where("group_id = 3").collect()} == {(3, "b", "a")}
    assert {(r.group_id, r.plan_id) for r in D.label_plans(D.with_costs(plans)).where("is_best").collect()} == {(1, "a"), (2, "a"), (3, "b")}


def test_verdicts(spark):
    rows = [(1, 0, 5.0, False), (1, 1, 4.0, False), (2, 0, 5.0, False), (2, 1, 6.0, False), (3, 0, 5.0, False), (4, 0, 5.0, False), (4, 1, 5.0, False), (5, 0, 9.0, True), (5, 1, 4.0, False), (6, 0, 5.0, False), (6, 1, 3.0, True)]
    # a censored cost is a lower bound: no lower than the best exact plan without, it has lost
    rows += [(7, 0, 5.0, False), (7, 1, 9.0, True), (8, 0, 5.0, False), (8, 1, 5.0, True), (9, 0, 5.0, False), (9, 0, 2.0, True), (9, 1, 4.0, False), (10, 0, 5.0, False), (10, 1, 4.0, False), (10, 1, 1.0, True)]
    found = D.verdicts(spark.createDataFrame(rows, "group_id int, cartesian int, y double, censored boolean")).collect()
    assert {r.group_id: r.verdict for r in found} == {1: "cartesian", 2: "connected", 3: "free", 4: "tie", 5: "unknown", 6: "unknown", 7: "connected", 8: "connected", 9: "cartesian", 10: "cartesian"}


def test_plans_are_stored_by_source(spark, plans, tmp_path):
    both = D.combined(a=plans, b=plans.where("group_id = 1"))
    D.write_plans(both, str(tmp_path / "p"))
    assert D.read_plans(spark, str(tmp_path / "p")).count() == both.count() and D.read_plans(spark, str(tmp_path / "p"), ["b"]).count() == 3


def test_queries_are_written_and_read(spark, stored, tmp_path):
    D.write_queries(stored, str(tmp_path / "q"))
    back = D.read_queries(spark, str(tmp_path / "q"), lines=True)
    assert sorted((r.query_id, r.y or 0) for r in back.collect()) == sorted((r.query_id, r.y or 0) for r in stored.collect())


def test_assembled_plans(spark):
    triples = [("?x", "p", "?y"), ("?y", "q", "?z"), ("?u", "q", "a")]
    rows = [(triples, [0, 1, 2], 10, False), (triples, [0, 2, 1], 30, False), (triples, [1, 0, 2], 5, True), (triples, [2, 1, 0], 0, False)]
    costs = spark.createDataFrame(rows, "triples array<struct<s:string,p:string,o:string>>, ord array<int>, c_out long, censored boolean")
    found = D.assembled(costs).orderBy("y").collect()
    assert [(r.y, r.cartesian, r.size, len(r.edges)) for r in found] == [(10, True, 3, 4), (30, True, 3, 4)] and found[0].group_id == found[1].group_id


def test_large_groups_meet_in_parts(spark, plans):
    for size in (1, 2, 100):
        pairs = pairs_within(plans, ["group_id"], ["plan_id"], size).collect()
        assert sorted((r.group_id, r.a.plan_id, r.b.plan_id) for r in pairs) == sorted((g, a, b) for g, m in ((1, "abc"), (2, "a"), (3, "ab"), (4, "ab")) for a in m for b in m)


def test_result_and_history_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"query_id": 1, "ntriplepattern": 3, "plans": {"a": {"predicted_cost": 2.0, "real_cost": float("inf")}, "b": {"predicted_cost": 1.0}}}, {"query_id": 2}, {"query_id": 3, "plans": {"a": {"real_cost": 7.0, "predicted_cost": 1}}}]))
    found = {(r.query_id, r.method): (r["size"], r.predicted_cost, r.real_cost) for r in A.read_results(spark, str(tmp_path / "r.json")).collect()}
    assert found == {(1, "a"): (3, 2.0, None), (1, "b"): (3, 1.0, None), (3, "a"): (0, 1.0, 7.0)}
    (tmp_path / "h.json").write_text(json.dumps([{"iteration": k, "loss": float(k % 5 + (k % 2) * 10), "params": {"x": float(k % 2), **({"y": 1.0} if k % 3 else {})}} for k in range(40)]))
    history = A.read_history(spark, str(tmp_path / "h.json"), ["x", "y"])
    assert history.count() == 40 and history.where("y IS NULL").count() == 14
    weights = {r["column"]: r.importance for r in A.importance(history, ["x", "y"], trees=20).collect()}
    assert weights["x"] > 0.8
    ends = A.extremes(history, share=0.2).groupBy("bucket").agg({"loss": "max"}).collect()
    assert {r[0] for r in ends} == {"best", "worst"}


def test_samples_by_size_and_scalar_metrics(spark):
    queries = spark.createDataFrame([(i, i % 3) for i in range(90)], "query_id int, size int")
    parts = [{r.query_id for r in A.sample_by_size(queries, 10, 1, skip).collect()} for skip in (0, 10, 20)]
    assert set.union(*parts) == set(range(90)) and sum(map(len, parts)) == 90
    row = spark.range(1).select(M.squash(F.lit(-3.0)).alias("a"), M.q_error_log(F.lit(1.0), F.lit(2.0)).alias("b"), M.shown(F.lit(1236.0), F.lit(True)).alias("c"), M.orders_of_magnitude(F.lit(1000.0), F.lit(10.0)).alias("d"), M.ramp(F.lit(5), 0.0, 1.0, 10).alias("e"), M.ramp(F.lit(50), 0.0, 1.0, 10).alias("f")).first()
    assert row.a == pytest.approx(-math.log(4)) and row.b == pytest.approx(math.e) and row.c == ">=1.236e+03" and row.d == pytest.approx(2.0) and (row.e, row.f) == (0.5, 1.0)


def test_quotas_and_blocks(spark):
    strata = spark.createDataFrame([("a", 1), ("b", 16), ("c", 81)], "stratum string, n long")
    assert {r.stratum: r.quota for r in D.quotas(strata, 14).collect()} == {"a": 1, "b": 4, "c": 9}
    rows = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(3)], "s string, k int")
    blocks = [{(r.s, r.k) for r in D.block(rows, "s", "k", 5, j).collect()} for j in range(2)]
    assert len(blocks[0] | blocks[1]) == 13 and not {x for x in blocks[0] & blocks[1] if x[0] == "a"}


def test_analytics(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 3, "a", 10.0, 10.0), (1, 3, "b", 10.0, 20.0), (2, 3, "a", 5.0, 30.0), (2, 3, "b", nan, 30.1), (3, 4, "a", 1.0, inf), (3, 4, "b", 2.0, 8.0)]
    results = spark.createDataFrame(rows, "query_id int, size int, method string, predicted_cost double, real_cost double")
    assert {(r.a, r.b): r.rate for r in A.win_rates(results).collect()} == {("a", "b"): 1.0, ("b", "a"): 0.0}
    gaps = {(r.method, r["size"]): r.gap for r in A.optimality_gap(results).collect()}
    assert gaps["b", 4] == 1.0 and gaps["a", 3] == 1.0 and gaps["b", 3] == pytest.approx((2 + 30.1 / 30) / 2)
    assert {r.method: r.share for r in A.performance_profile(results, [1.0]).collect()} == {"a": 1.0, "b": pytest.approx(1 / 3)}
    assert {r["size"]: r.n for r in A.q_error_summary(results).collect()} == {3: 3, 4: 1}
    assert A.head_to_head(results, "a", "b").first().a_lost == 1
    assert [r.n for r in A.best_of_n(results, [1, 2]).orderBy("n").collect()] == [1, 2]
    assert {r.value for r in A.normalised(spark.createDataFrame([(1.0,), (3.0,)], "value double"), "value").collect()} == {0.0, 1.0}
