"""Plans of a whole table of queries, as column expressions.

A query is one row with its patterns (array of struct s, p, o; a dozen or so), so
what concerns one query's patterns and orders is worked out inside its row, with
no shuffle. ``names`` below is the array of each pattern's variables, an order is
an array of pattern numbers, and an edge array holds (child, parent) structs of a
tree with patterns 0..n-1 and joins n..2n-2.

Choices that are arbitrary follow ``draw``, a hash that any SQL engine can compute.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.session import durable

#: Rows worked on by one task where each takes long, and kinds of rows that are broadcast at most.
ROWS_A_TASK, FEW = 5_000, 10_000


def spread(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``n`` rows dealt by ``keys`` over tasks of about ROWS_A_TASK, however few bytes they have."""
    return rows.repartition(max(1, -(-n // ROWS_A_TASK)), *keys)


def by_kind(rows: DataFrame, key: dict[str, Column], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with what ``work`` makes of the distinct values of the ``key`` columns, which stay.

    Queries of one shape are alike but for their constants, so what depends on the
    shape alone is worked out once for it. ``work`` may give several rows a kind, or none.
    """
    keyed = rows.withColumns(key)
    kinds = durable(keyed.select(*key).distinct())
    n = kinds.count()
    found = work(spread(kinds, n, *key))
    found = found.withColumnsRenamed({c: f"_{c}" for c in key})
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return keyed.join(F.broadcast(found) if n <= FEW else found, same).drop(*[f"_{c}" for c in key])


def is_variable(term: Column) -> Column:
    return term.startswith("?")


def names_of(triples: Column) -> Column:
    """The distinct variables of each pattern."""
    return F.transform(triples, lambda t: F.array_distinct(F.filter(F.array(t["s"], t["p"], t["o"]), is_variable)))


def numbers(n: Column) -> Column:
    """0..n-1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def draw(seed: int, *columns: Column) -> Column:
    """A hexadecimal number that orders rows or patterns at random."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def shared_counts(names: Column) -> Column:
    """(i, j, n) structs: patterns that share n variables, n > 0."""
    rows = F.transform(numbers(F.size(names)), lambda i: F.transform(numbers(F.size(names)), lambda j: F.struct(i.alias("i"), j.alias("j"), F.size(F.array_intersect(F.get(names, i), F.get(names, j))).alias("n"))))
    return F.filter(F.flatten(rows), lambda x: (x["i"] != x["j"]) & (x["n"] > 0))


def component_labels(names: Column) -> Column:
    """The least pattern that each pattern is connected to by shared variables."""
    every = numbers(F.size(names))
    near = lambda i: F.filter(every, lambda j: (i == j) | F.arrays_overlap(F.get(names, i), F.get(names, j)))
    step = lambda labels, _: F.transform(every, lambda i: F.array_min(F.transform(near(i), lambda j: F.get(labels, j))))
    return F.aggregate(every, every, step)


def cartesian_joins(order: Column, names: Column) -> Column:
    """Joins of a left-deep order that share no variable with what is before them."""
    start = F.struct(F.get(names, F.get(order, F.lit(0))).alias("seen"), F.lit(0).alias("n"))

    def step(acc: Column, i: Column) -> Column:
        here = F.get(names, i)
        return F.struct(F.array_union(acc["seen"], here).alias("seen"), (acc["n"] + F.when(F.arrays_overlap(acc["seen"], here), 0).otherwise(1)).alias("n"))

    return F.aggregate(F.slice(order, F.lit(2), F.greatest(F.size(order) - 1, F.lit(0))), start, step, lambda acc: acc["n"])


def completed(prefix: Column, names: Column, pick, other: bool = True) -> Column:
    """A prefix extended by patterns that share a variable with what is before them.

    ``pick`` chooses among candidates (an array of pattern numbers). Where none
    shares, any other is taken if ``other``; else the order stays short.
    """
    n = F.size(names)

    def step(order: Column, _: Column) -> Column:
        seen = F.flatten(F.transform(order, lambda i: F.get(names, i)))
        left = F.array_except(numbers(n), order)
        near = F.filter(left, lambda i: F.arrays_overlap(F.get(names, i), seen))
        pool = F.when((F.size(near) == 0) & F.lit(other), left).otherwise(near)
        return F.when(F.size(pool) > 0, F.concat(order, F.array(pick(pool)))).otherwise(order)

    return F.aggregate(numbers(n), prefix, step)


def first_of(pool: Column) -> Column:
    return F.array_min(pool)


def drawn(seed: int, query: Column):
    """A ``pick`` by a seeded hash of query and pattern."""
    return lambda pool: F.array_min(F.transform(pool, lambda i: F.struct(draw(seed, query, i).alias("at"), i.alias("i"))))["i"]


def connected_order(triples: Column) -> Column:
    """From the pattern with most constants, always the first that shares a variable; NULL if the query falls apart."""
    return connected_order_of(names_of(triples), constants_of(triples))


def constants_of(triples: Column) -> Column:
    """The number of constants of each pattern."""
    return F.transform(triples, lambda t: F.size(F.filter(F.array(t["s"], t["p"], t["o"]), lambda x: ~is_variable(x))))


def connected_order_of(names: Column, constants: Column) -> Column:
    """``connected_order`` of the patterns' variables and numbers of constants."""
    ranked = F.transform(constants, lambda k, i: F.struct((-k).alias("k"), i.alias("i")))
    order = completed(F.array(F.array_min(ranked)["i"]), names, first_of, other=False)
    return F.when(F.size(names) == 0, F.array().cast("array<int>")).when(F.size(order) == F.size(names), order)


def canonical(order: Column) -> Column:
    """The first two patterns of a left-deep order may change places."""
    return F.concat(F.array_sort(F.slice(order, 1, 2)), F.slice(order, F.lit(3), F.greatest(F.size(order) - 2, F.lit(0))))


def problems(order: Column, n: Column) -> Column:
    """missing, repeated and unknown patterns of a plan, each in order."""
    twice = F.array_distinct(F.filter(order, lambda i: F.size(F.filter(order, lambda j: i == j)) > 1))
    return F.struct(F.array_except(numbers(n), order).alias("missing"), F.array_sort(twice).alias("repeated"), F.array_sort(F.array_except(order, numbers(n))).alias("unknown"))


def left_deep_edges(order: Column) -> Column:
    """Child-to-parent edges of a left-deep order, the root last."""
    n = F.size(order)
    own = F.transform(order, lambda i, k: F.struct(i.alias("child"), (n + F.greatest(k - 1, F.lit(0))).alias("parent")))
    joins = F.transform(numbers(F.greatest(n - 2, F.lit(0))), lambda k: F.struct((n + k).alias("child"), (n + k + 1).alias("parent")))
    return F.when(n < 2, F.array().cast("array<struct<child:int,parent:int>>")).otherwise(F.concat(own, joins))


def tree_patterns(edges: Column, n: Column) -> Column:
    """For each join the set of patterns below it; NULL where the edges are no tree of them."""
    leaves = F.transform(numbers(n), lambda i: F.array(i))
    unknown = F.transform(numbers(F.greatest(n - 1, F.lit(0))), lambda _: F.lit(None).cast("array<int>"))

    def step(cover: Column, _: Column) -> Column:
        def join(below: Column, j: Column) -> Column:
            parts = F.transform(F.filter(edges, lambda e: e["parent"] == j), lambda e: F.get(cover, e["child"]))
            whole = (F.size(parts) > 0) & ~F.exists(parts, lambda p: p.isNull())
            return F.when((j >= n) & below.isNull() & whole, F.array_sort(F.array_distinct(F.flatten(parts)))).otherwise(below)

        return F.transform(cover, join)

    return F.slice(F.aggregate(numbers(n), F.concat(leaves, unknown), step), n + 1, F.greatest(n - 1, F.lit(0)))


def tree_cartesian_joins(edges: Column, names: Column) -> Column:
    """Joins of any plan tree whose two sides share no variable; -1 where the edges are no tree."""
    n = F.size(names)
    joins = tree_patterns(edges, n)
    variables = lambda patterns: F.flatten(F.transform(patterns, lambda i: F.get(names, i)))
    cover = lambda c: F.when(c < n, F.array(c)).otherwise(F.get(joins, c - n))
    sides = F.transform(numbers(F.greatest(n - 1, F.lit(0))), lambda k: F.transform(F.filter(edges, lambda e: e["parent"] == n + k), lambda e: cover(e["child"])))
    apart = F.filter(sides, lambda s: (F.size(s) == 2) & ~F.arrays_overlap(variables(F.get(s, F.lit(0))), variables(F.get(s, F.lit(1)))))
    return F.when(F.exists(joins, lambda p: p.isNull()), -1).otherwise(F.size(apart))


def masks_of(joins: Column) -> Column:
    """Each set of patterns as a number with a bit for each."""
    bit = lambda acc, i: acc + F.call_function("shiftleft", F.lit(1), i)
    return F.transform(joins, lambda patterns: F.aggregate(patterns, F.lit(0), bit))


def family(queries: DataFrame, siblings: int = 8, alternatives: int = 2, cartesian: int = 2, randoms: int = 2, seed: int = 0) -> DataFrame:
    """query_id, kind, ord: alternative left-deep orders of each query (query_id, triples), equal ones once.

    ``base``: a random start, then random sharing patterns. ``sibling``: another
    sharing pattern at some depth, then completed, with as few cartesian joins as
    the query needs at all. ``cartesian``: a pattern that shares nothing at some
    depth, with exactly one more. ``random``: any order. An order of several kinds
    has the first of them. The numbers bound what is kept of each kind.
    """
    q, triples = F.col("query_id"), F.col("triples")
    names, n = F.col("names"), F.size("names")
    rows = queries.where(F.size(triples) > 0).select(q, names_of(triples).alias("names"))
    by_draw = lambda s: F.transform(F.array_sort(F.transform(numbers(n), lambda i: F.struct(draw(s, q, i).alias("at"), i.alias("i")))), lambda x: x["i"])
    # a query's random choices of a next pattern follow one drawn ranking of its patterns
    first = lambda pool: F.get(F.filter("place", lambda i: F.array_contains(pool, i)), F.lit(0))

    def extended(kinds: DataFrame) -> DataFrame:
        """The base order of each kind of query and, by depth, the orders that another pattern there leads to."""
        kinds = kinds.withColumn("least", F.size(F.array_distinct(component_labels(names))) - 1).withColumn("base", completed(F.array("start"), names, first))
        at = F.explode_outer(F.when(n > 1, F.sequence(F.lit(1), n - 1))).alias("k")
        deep = kinds.select("*", at).withColumn("prefix", F.slice("base", F.lit(1), F.col("k")))
        deep = deep.select("*", F.explode_outer(F.array_except(numbers(n), F.col("prefix"))).alias("i"))
        near = F.arrays_overlap(F.get(names, F.col("i")), F.flatten(F.transform("prefix", lambda i: F.get(names, i))))
        deep = deep.select("*", near.alias("near"), completed(F.concat("prefix", F.array("i")), names, first).alias("ord"))
        more = (cartesian_joins(F.col("ord"), names) - F.col("least")).alias("more")
        other = F.struct("k", "i", "near", (F.col("i") == F.get("base", F.col("k"))).alias("same"), more, "ord")
        grouped = deep.groupBy("names", "place", "start", "base").agg(F.collect_list(other).alias("others"))  # the square of a query's patterns
        depths = F.transform(numbers(n - 1), lambda k: F.filter("others", lambda x: x["k"] == k + 1))
        return grouped.select("names", "place", "start", "base", depths.alias("depths"))

    rows = by_kind(rows, {"place": by_draw(seed), "start": F.get(by_draw(seed + 1), F.lit(0)), "names": names}, extended)

    def taken(good, s: int, each: int, more: int, most: int) -> Column:
        """Of each depth's good ones ``each`` by a draw, of these with so many cartesian joins ``most`` by another."""
        by = lambda pool: F.slice(F.array_sort(F.transform(F.filter(pool, good), lambda x: F.struct(draw(s, q, x["k"], x["i"]).alias("at"), x["i"].alias("i"), x.alias("x")))), 1, each)
        some = F.filter(F.transform(F.flatten(F.transform("depths", by)), lambda y: y["x"]), lambda x: x["more"] == more)
        best = F.array_sort(F.transform(some, lambda x: F.struct(draw(seed + 4, q, x["k"], x["i"]).alias("at"), x["ord"].alias("ord"))))
        return F.transform(F.slice(best, 1, most), lambda x: x["ord"])

    near, far = taken(lambda x: x["near"] & ~x["same"], seed + 2, alternatives, 0, siblings), taken(lambda x: ~x["near"], seed + 3, 1, 1, cartesian)
    kinds = [("base", F.array("base")), ("sibling", near), ("cartesian", far), ("random", F.array(*[by_draw(s) for s in range(seed + 5, seed + 5 + randoms)]))]
    ranked = lambda r, orders: F.transform(orders, lambda o: F.struct(F.lit(r).alias("rank"), o.alias("ord")))
    every = F.concat(*[ranked(r, orders) for r, (kind, orders) in enumerate(kinds) if kind != "random" or randoms])
    found = rows.select("query_id", F.explode(every).alias("x")).groupBy("query_id", "x.ord").agg(F.min("x.rank").alias("rank"))
    return found.select("query_id", F.get(F.array(*[F.lit(kind) for kind, _ in kinds]), F.col("rank")).alias("kind"), "ord")


def broken(plans: DataFrame, seed: int = 0) -> DataFrame:
    """Plans (query_id, plan_id, n, edges) made invalid: some edges gone, new ones added, at least one change; y is infinite.

    At most half of the edges go and as many are added, none of which the plan had.
    """
    key = (F.col("query_id"), F.col("plan_id"))
    half = F.greatest(F.floor(F.size("edges") / 2), F.lit(1))
    number = lambda s: F.conv(F.substring(draw(s, *key), 1, 8), 16, 10).cast("long")
    gone = F.pmod(number(seed), half + 1).cast("int")
    more = F.when(F.col("_gone") == 0, F.greatest(F.pmod(F.col("_more"), half + 1), F.lit(1))).otherwise(F.pmod(F.col("_more"), half + 1)).cast("int")
    # what starts the drawn texts of a plan, made once for it
    rows = plans.withColumns({"_gone": gone, "_more": number(seed + 1)} | {f"_at{k}": F.concat_ws("|", F.lit(str(seed + k)), *key) for k in (2, 3)})
    rows = rows.withColumn("_more", more)

    def changes(kinds: DataFrame) -> DataFrame:
        """The edges of each kind of plan and those that it has not, with their numbers as text."""
        nodes = numbers(2 * F.col("n") - 1)
        every = F.flatten(F.transform(nodes, lambda a: F.transform(nodes, lambda b: F.struct(a.alias("child"), b.alias("parent")))))
        named = lambda xs: F.transform(xs, lambda x: F.struct(x["child"].cast("string").alias("c"), x["parent"].cast("string").alias("p"), x.alias("x")))
        return kinds.select("n", "edges", named(F.col("edges")).alias("_old"), named(F.filter(every, lambda x: ~F.array_contains("edges", x))).alias("_new"))

    rows = by_kind(rows, {"n": F.col("n"), "edges": F.col("edges")}, changes)
    order = lambda xs, at: F.transform(F.array_sort(F.transform(xs, lambda x: F.struct(F.md5(F.concat_ws("|", at, x["c"], x["p"])).alias("at"), x["x"].alias("x")))), lambda y: y["x"])
    kept = F.slice(order("_old", F.col("_at2")), F.col("_gone") + 1, F.greatest(F.size("edges") - F.col("_gone"), F.lit(0)))
    changed = F.concat(kept, F.slice(order("_new", F.col("_at3")), F.lit(1), F.col("_more")))
    return rows.select(*[changed.alias(c) if c == "edges" else F.col(c) for c in plans.columns], F.lit(float("inf")).alias("y"))
