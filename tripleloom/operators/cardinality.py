"""Exact cardinalities of sub-patterns and the cost of plans.

The cost of a plan is the sum of the result sizes of its joins. A set of
patterns falls into components without common variables; each component is
counted once, whatever plans need it, and the product of components is never
executed as a join. A connected set is counted from smaller ones: what is kept
of them are the bindings of the variables that the set itself still needs, with
their multiplicities; what several sets are counted from is written once.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.plans import table as T
from tripleloom.plans.bgp import Pattern, components, key_of, totals
from tripleloom.session import durable


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def subsets(n: int) -> list[tuple[int, ...]]:
    return [c for k in range(1, n + 1) for c in combinations(range(n), k)]


def grown_from(patterns: Sequence[Pattern], wanted: Iterable[tuple[int, ...]]) -> dict[tuple[int, ...], int | None]:
    """The connected sets to count for the wanted ones: each set's last pattern, without which it is connected and in the table too."""
    out: dict[tuple[int, ...], int | None] = {}
    todo = sorted(set(wanted), key=lambda c: (-len(c), c))
    while todo:
        here = todo.pop(0)
        if here in out:
            continue
        smaller = {i: tuple(j for j in here if j != i) for i in here} if len(here) > 1 else {}
        smaller = {i: x for i, x in smaller.items() if len(components(patterns, x)) == 1}
        # one that is counted anyway, if there is any
        out[here] = min(smaller, key=lambda i: (smaller[i] not in out and smaller[i] not in todo, smaller[i])) if smaller else None
        if smaller and smaller[out[here]] not in out:
            todo = sorted({*todo, smaller[out[here]]}, key=lambda c: (-len(c), c))
    return out


def connected_counts(kg: DataFrame, patterns: Sequence[Pattern], wanted: Iterable[tuple[int, ...]]) -> DataFrame:
    """mask, cnt of connected sets of patterns, written: each keeps the variables that it needs itself, never those of others."""
    found = totals(kg, patterns, wanted)
    rows = [x.select(F.lit(sum(1 << i for i in c)).alias("mask"), F.col("_m").cast("long").alias("cnt")) for c, x in found.items()]
    return durable(union(rows))  # a row for each set of patterns


def component_counts(kg: DataFrame, patterns: Sequence[Pattern], wanted: Iterable[tuple[int, ...]], cache: DataFrame | None = None) -> DataFrame:
    """key, mask, cnt of every distinct component of the wanted sets.

    ``cache`` (key, cnt) holds what is known already; only the rest is counted. A
    cnt of -1 there is a count that failed: it is not tried again.
    """
    spark = kg.sparkSession
    parts = sorted({c for w in wanted for c in components(patterns, w)})
    names = spark.createDataFrame([(key_of(patterns, c), sum(1 << i for i in c)) for c in parts], "key string, mask int")
    if cache is None:
        return names.join(connected_counts(kg, patterns, parts), "mask").select("key", "mask", "cnt")
    known = cache.join(F.broadcast(names), "key").groupBy("key", "mask").agg(F.first("cnt").alias("cnt"))
    found = {r.key for r in known.select("key").collect()}  # components of one query
    fresh = [c for c in parts if key_of(patterns, c) not in found]
    if not fresh:
        return known.select("key", "mask", "cnt")
    return known.select("key", "mask", "cnt").unionByName(names.join(connected_counts(kg, patterns, fresh), "mask").select("key", "mask", "cnt"))


def remember(cache: DataFrame | None, counted: DataFrame) -> DataFrame:
    """The cache with new counts; the first count of a key stays."""
    fresh = counted.select("key", "cnt")
    return fresh.dropDuplicates(["key"]) if cache is None else cache.unionByName(fresh.join(cache, "key", "left_anti")).dropDuplicates(["key"])


def subset_cards(kg: DataFrame, patterns: Sequence[Pattern], wanted: Sequence[tuple[int, ...]] | None = None, cache: DataFrame | None = None) -> DataFrame:
    """mask, card (decimal) of sets of patterns; NULL where the product overflows or a count failed."""
    wanted = list(wanted or subsets(len(patterns)))
    counts = component_counts(kg, patterns, wanted, cache)
    rows = [(sum(1 << i for i in w), sum(1 << i for i in c)) for w in wanted for c in components(patterns, w)]
    parts = kg.sparkSession.createDataFrame(rows, "mask int, part int")
    joined = F.broadcast(parts).join(counts.select(F.col("mask").alias("part"), "cnt"), "part")
    product = F.aggregate(F.collect_list(F.when(F.col("cnt") >= 0, F.col("cnt")).cast("decimal(38,0)")), F.lit(1).cast("decimal(38,0)"), lambda acc, x: F.try_multiply(acc, x).cast("decimal(38,0)"))
    failed = F.bool_or(F.col("cnt") < 0)
    return joined.groupBy("mask").agg(F.when(~failed, product).alias("card"))


def order_table(spark: SparkSession, orders: Iterable[Sequence[int]]) -> DataFrame:
    """order_id, ord (array of pattern numbers)."""
    return spark.createDataFrame([(k, list(o)) for k, o in enumerate(orders)], "order_id int, ord array<int>")


def all_orders(spark: SparkSession, n: int) -> DataFrame:
    return order_table(spark, permutations(range(n)))


def prefix_cards(orders: DataFrame, cards: DataFrame) -> DataFrame:
    """order_id, ord, k, card: the size of each prefix of two patterns or more."""
    steps = orders.select("order_id", "ord", F.explode(F.sequence(F.lit(1), F.size("ord"))).alias("k"))
    masks = F.aggregate(F.slice("ord", F.lit(1), F.col("k")), F.lit(0), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1), i)))
    return steps.withColumn("mask", masks).join(F.broadcast(cards), "mask", "left").select("order_id", "ord", "k", "card")


def c_out(orders: DataFrame, cards: DataFrame) -> DataFrame:
    """order_id, ord, c_out, censored: the cost of each order; a lower bound if a size is unknown."""
    steps = prefix_cards(orders, cards).where((F.col("k") >= 2) | (F.size("ord") == 1))
    cost = F.coalesce(F.sum(F.when(F.col("k") >= 2, F.col("card"))), F.lit(0)).cast("decimal(38,0)")
    return steps.groupBy("order_id", "ord").agg(cost.alias("c_out"), F.bool_or((F.col("k") >= 2) & F.col("card").isNull()).alias("censored"))


def best(costs: DataFrame, worst: bool = False) -> DataFrame:
    """The cheapest (or dearest) order; the first of equal ones."""
    pick = F.max_by if worst else F.min_by
    rank = F.struct("c_out", -F.col("order_id")) if worst else F.struct("c_out", "order_id")
    return costs.where(~F.col("censored")).agg(pick(F.struct("order_id", "ord", "c_out"), rank).alias("x")).select("x.*")


def tree_costs(plans: DataFrame, cards: DataFrame, n: int) -> DataFrame:
    """plan_id, c_out, censored of plans of any shape (plan_id, edges) over n patterns; NULL where the edges are no tree."""
    joins = plans.select("plan_id", T.tree_patterns(F.col("edges"), F.lit(n)).alias("joins"))
    good = ~F.exists("joins", lambda x: x.isNull())
    masks = joins.select("plan_id", F.explode_outer(F.when(good, T.masks_of(F.col("joins")))).alias("mask"))
    found = masks.join(F.broadcast(cards), "mask", "left")  # sets of one query's patterns
    return found.groupBy("plan_id").agg(F.sum("card").cast("decimal(38,0)").alias("c_out"), F.bool_or(F.col("mask").isNotNull() & F.col("card").isNull()).alias("censored"))


def card_targets(orders: DataFrame, cards: DataFrame) -> DataFrame:
    """order_id, ord, k, target, valid: the log size of each join's result; 0 and not valid where it is unknown or empty."""
    steps = prefix_cards(orders, cards).where("k >= 2")
    valid = F.coalesce(F.col("card") > 0, F.lit(False))
    return steps.select("order_id", "ord", "k", F.when(valid, F.ln(F.col("card").cast("double"))).otherwise(0.0).alias("target"), valid.alias("valid"))


def fanout_bounds(orders: DataFrame, stats: DataFrame) -> DataFrame:
    """query_id, plan_id, log_bound: the log of an upper bound of each order's final size (query_id, plan_id, triples, ord).

    A join over a bound subject multiplies by the most objects a subject of the
    predicate has, one over a bound object by the most subjects an object has, one
    over neither by the predicate's triples. ``stats`` has a row for each predicate and is broadcast: steps of a few
    predicates, shuffled by them, would meet in a few tasks.
    """
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<struct<p:string,sb:boolean,ob:boolean>>").alias("steps"))

    def step(acc: Column, i: Column) -> Column:
        t = F.get(F.col("triples"), i)
        bound = lambda x: ~T.is_variable(x) | F.array_contains(acc["seen"], x)
        return F.struct(F.array_union(acc["seen"], F.array(t["s"], t["p"], t["o"])).alias("seen"), F.concat(acc["steps"], F.array(F.struct(t["p"].alias("p"), bound(t["s"]).alias("sb"), bound(t["o"]).alias("ob")))).alias("steps"))

    steps = orders.select("query_id", "plan_id", F.explode(F.aggregate("ord", start, step, lambda acc: acc["steps"])).alias("x")).select("query_id", "plan_id", "x.*")
    factor = F.when(F.col("sb") & F.col("ob"), F.lit(1)).when(F.col("sb"), F.col("max_out")).when(F.col("ob"), F.col("max_in")).otherwise(F.col("count"))
    return steps.join(F.broadcast(stats), "p").groupBy("query_id", "plan_id").agg(F.sum(F.ln(factor.cast("double"))).alias("log_bound"))
