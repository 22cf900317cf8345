"""Basic graph patterns: conjunctions of triple patterns over a graph.

A term that starts with ``?`` is a variable; everything else is a constant. A
plan is a left-deep order of pattern numbers.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.session import durable


@dataclass(frozen=True)
class Pattern:
    s: str
    p: str
    o: str

    @property
    def variables(self) -> frozenset[str]:
        return frozenset(t for t in (self.s, self.p, self.o) if t.startswith("?"))

    def __str__(self) -> str:
        return f"{self.s} {self.p} {self.o} ."


def parse(text: str) -> Pattern:
    """A pattern from ``subject predicate object [.]``; the object may hold spaces."""
    parts = text.strip().split(None, 2)
    if len(parts) < 3:
        raise ValueError(f"a triple pattern needs three terms: {text!r}")
    last = parts[2].strip()
    return Pattern(parts[0], parts[1], last[:-1].rstrip() if last.endswith(".") else last)


def parse_all(texts: Iterable[str]) -> list[Pattern]:
    return [parse(t) for t in texts]


def scan(kg: DataFrame, pattern: Pattern) -> DataFrame:
    """The bindings of one pattern, a column for each variable (its name without ``?``)."""
    out = kg
    first: dict[str, str] = {}
    for column, name in zip("spo", (pattern.s, pattern.p, pattern.o), strict=True):
        if not name.startswith("?"):
            out = out.where(F.col(column) == name)
        elif name in first:
            out = out.where(F.col(column) == F.col(first[name]))
        else:
            first[name] = column
    return out.select(*(F.col(c).alias(v[1:]) for v, c in first.items()))


def solve(kg: DataFrame, patterns: Sequence[Pattern], order: Sequence[int] | None = None) -> DataFrame:
    """All solutions, joined in the given order; patterns without a common variable multiply."""
    order = range(len(patterns)) if order is None else order

    def join(left: DataFrame, right: DataFrame) -> DataFrame:
        shared = sorted(set(left.columns) & set(right.columns))
        return left.join(right, shared) if shared else left.crossJoin(right)

    return reduce(join, (scan(kg, patterns[i]) for i in order))


#: Patterns and the variables of them that are kept; all others are summed out.
Factor = tuple[tuple[int, ...], frozenset[str]]

#: A factor of so few rows at most is broadcast.
SMALL = 100_000


def measured(kg: DataFrame, patterns: Sequence[Pattern], members: Iterable[int]) -> dict[int, tuple[int, dict[str, int]]]:
    """Triples of each pattern and, roughly, the distinct values of its variables; one job."""
    found = []
    for i in sorted(members):
        names = sorted(patterns[i].variables)
        distinct = [F.struct(F.lit(v).alias("v"), F.approx_count_distinct(v[1:]).alias("n")) for v in names]
        empty = F.array().cast("array<struct<v:string,n:bigint>>")
        found.append(scan(kg, patterns[i]).agg(F.lit(i).alias("i"), F.count(F.lit(1)).alias("n"), (F.array(*distinct) if distinct else empty).alias("d")))
    return {r.i: (r.n, {x.v: x.n for x in r.d}) for r in reduce(DataFrame.unionByName, found).collect()}  # a row for each pattern


def contraction(patterns: Sequence[Pattern], sizes: dict[int, tuple[int, dict[str, int]]], goals: Iterable[tuple[int, ...]]) -> dict[Factor, tuple[Factor, ...] | None]:
    """The factors that count the goals (connected sets), each with the two it is joined from, by the least rows in all.

    A factor keeps the variables that its own goal still needs and no others, so a
    cycle is closed from the side where its open ends have the fewest bindings.
    Where another factor of the same patterns keeps more variables, it is summed
    from that one instead.
    """
    inside = lambda members: frozenset().union(*(patterns[i].variables for i in members))
    known: dict[Factor, tuple[float, float, tuple[Factor, Factor] | None]] = {}

    def domain(members: tuple[int, ...], v: str) -> int:
        return max(1, min(sizes[i][1][v] for i in members if v in patterns[i].variables))

    def best(factor: Factor) -> tuple[float, float, tuple[Factor, Factor] | None]:
        """(rows in all, rows of the factor, the two it is joined from)"""
        if factor in known:
            return known[factor]
        members, keep = factor
        most = 1.0
        for v in keep:
            most *= domain(members, v)
        if len(members) == 1:
            known[factor] = (float(sizes[members[0]][0]), min(most, max(1, sizes[members[0]][0])), None)
            return known[factor]
        found = None
        for k in range(len(members) - 1):
            for others in combinations(members[1:], k):
                one = (members[0], *others)
                two = tuple(i for i in members if i not in one)
                shared = inside(one) & inside(two)
                if not shared or len(components(patterns, one)) > 1 or len(components(patterns, two)) > 1:
                    continue
                left, right = (one, inside(one) & (keep | shared)), (two, inside(two) & (keep | shared))
                (cost, n, _), (more, m, _) = best(left), best(right)
                rows = n * m
                for v in shared:
                    rows /= max(min(domain(one, v), n), min(domain(two, v), m))
                if found is None or cost + more + n + m + rows < found[0]:
                    found = (cost + more + n + m + rows, min(most, max(rows, 1.0)), (left, right))
        known[factor] = found
        return found

    out: dict[Factor, tuple[Factor, ...] | None] = {}
    todo: set[Factor] = {(tuple(g), frozenset()) for g in goals}
    while todo:
        # those of more patterns and of more variables first: what a factor may be summed from is known by then
        here = max(todo, key=lambda f: (len(f[0]), len(f[1]), f[0], sorted(f[1])))
        todo.remove(here)
        wider = [f for f in out if f[0] == here[0] and f[1] > here[1]]
        out[here] = (min(wider, key=lambda f: (best(f)[1], sorted(f[1]))),) if wider else best(here)[2]
        if not wider:
            todo |= set(out[here] or ()) - out.keys()
    return out


def totals(kg: DataFrame, patterns: Sequence[Pattern], goals: Iterable[tuple[int, ...]]) -> dict[tuple[int, ...], DataFrame]:
    """One row, ``_m``, for each connected set of patterns: its number of solutions, which are never executed themselves.

    What is joined are bindings of the variables still needed with their
    multiplicities. A factor that several others are made from is written once,
    but for one pattern's whole bindings and those of few triples.
    """
    goals = sorted(set(goals))
    used = {i for g in goals for i in g}
    sizes = measured(kg, patterns, used) if max(map(len, goals)) > 1 else {i: (1, dict.fromkeys(patterns[i].variables, 1)) for i in used}
    plan = contraction(patterns, sizes, goals)
    uses = Counter(x for made_from in plan.values() if made_from for x in made_from)
    ready: dict[Factor, DataFrame] = {}

    def summed(df: DataFrame, keep: frozenset[str], m: Column) -> DataFrame:
        return df.groupBy(*sorted(v[1:] for v in keep)).agg(F.coalesce(F.sum(m), F.lit(0)).cast("decimal(38,0)").alias("_m"))

    def few(factor: Factor) -> bool:
        most = 1
        for v in factor[1]:
            most *= min(sizes[i][1][v] for i in factor[0] if v in patterns[i].variables)
        return most <= SMALL

    def of(factor: Factor) -> DataFrame:
        if factor in ready:
            return ready[factor]
        members, keep = factor
        whole = len(members) == 1 and keep == patterns[members[0]].variables
        if plan[factor] is None:
            found = scan(kg, patterns[members[0]])
            one = F.lit(1).cast("decimal(38,0)")
            # triples are distinct, so bindings of all variables are too
            found = found.select("*", one.alias("_m")) if keep and whole else summed(found, keep, one)
        elif len(plan[factor]) == 1:
            found = summed(of(plan[factor][0]), keep, F.col("_m"))
        else:
            left, right = plan[factor]
            if few(left) and not few(right):
                left, right = right, left
            a, b = of(left), of(right).withColumnRenamed("_m", "_n")
            joined = a.join(F.broadcast(b) if few(right) else b, sorted(v[1:] for v in left[1] & right[1]))
            m = (F.col("_m") * F.col("_n")).cast("decimal(38,0)")
            found = joined.withColumn("_m", m).drop("_n") if keep == left[1] | right[1] else summed(joined, keep, m)
        if uses[factor] > 1 and not whole and (len(members) > 1 or sizes[members[0]][0] > SMALL):
            found = durable(found)
        ready[factor] = found
        return found

    return {g: of((g, frozenset())) for g in goals}


def count(kg: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """One row, ``cnt``: the number of solutions; unconnected parts multiply."""
    found = [x.withColumnRenamed("_m", f"_m{k}") for k, x in enumerate(totals(kg, patterns, components(patterns)).values())]
    product = reduce(lambda a, b: (a * b).cast("decimal(38,0)"), [F.col(f"_m{k}") for k in range(len(found))])
    return reduce(DataFrame.crossJoin, found).select(product.cast("long").alias("cnt"))


def sharing(patterns: Sequence[Pattern]) -> list[list[int]]:
    """Numbers of variables that two different patterns share."""
    return [[len(a.variables & b.variables) if i != j else 0 for j, b in enumerate(patterns)] for i, a in enumerate(patterns)]


def components(patterns: Sequence[Pattern], members: Iterable[int] | None = None) -> list[tuple[int, ...]]:
    """Pattern numbers grouped by shared variables; constants do not connect."""
    left = sorted(range(len(patterns)) if members is None else set(members))
    out = []
    while left:
        group, names = [left.pop(0)], set()
        names |= patterns[group[0]].variables
        grew = True
        while grew:
            near = [i for i in left if patterns[i].variables & names]
            grew = bool(near)
            for i in near:
                left.remove(i)
                group.append(i)
                names |= patterns[i].variables
        out.append(tuple(sorted(group)))
    return sorted(out)


def key_of(patterns: Sequence[Pattern], members: Iterable[int]) -> str:
    """A name for a set of patterns that does not depend on their order."""
    return hashlib.sha1(" . ".join(sorted(str(patterns[i])[:-2] for i in members)).encode()).hexdigest()


def cartesian_joins(patterns: Sequence[Pattern], order: Sequence[int]) -> int:
    """Joins of a left-deep order that share no variable with what is before them."""
    seen, n = set(patterns[order[0]].variables), 0
    for i in order[1:]:
        n += not (patterns[i].variables & seen)
        seen |= patterns[i].variables
    return n


def connected_order(patterns: Sequence[Pattern]) -> list[int] | None:
    """Start at the pattern with most constants, then always the first that shares a variable; None if none does."""
    if not patterns:
        return []
    bound = [sum(not t.startswith("?") for t in (p.s, p.p, p.o)) for p in patterns]
    order = [max(range(len(patterns)), key=lambda i: (bound[i], -i))]
    seen = set(patterns[order[0]].variables)
    while len(order) < len(patterns):
        near = next((i for i in range(len(patterns)) if i not in order and patterns[i].variables & seen), None)
        if near is None:
            return None
        order.append(near)
        seen |= patterns[near].variables
    return order


def canonical(order: Sequence[int]) -> tuple[int, ...]:
    """The first two patterns of a left-deep order may change places."""
    return (*sorted(order[:2]), *order[2:])


def problems(order: Sequence[int], n: int) -> dict[str, list[int]]:
    """Patterns that a plan misses, has twice, or does not know."""
    return {"missing": sorted(set(range(n)) - set(order)), "repeated": sorted({i for i in order if list(order).count(i) > 1}), "unknown": sorted(set(order) - set(range(n)))}
