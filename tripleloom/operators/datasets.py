"""Data sets of queries and plans: reading, filtering, sampling, pairing and training targets.

``queries`` has query_id, triples (array of struct s, p, o), y; ``plans`` has
group_id (one query's plans), plan_id, source, y (true cost) and, where it is
needed, prediction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleloom.operators.pairs import pairs_within
from tripleloom.plans.table import cartesian_joins, draw, is_variable, left_deep_edges, names_of

ATOMS = ("s", "p", "o")


def read_queries(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Queries of JSON files of ``[{"triples": [[s, p, o(, ".")], ...], "y": n}, ...]``; a missing y is NULL.

    A file of one array is read by one task; with ``lines`` each line is a query,
    and a file is split.
    """
    raw = spark.read.schema("triples array<array<string>>, y long").json(path, multiLine=not lines)
    triples = F.transform("triples", lambda t: F.struct(*[t[i].alias(a) for i, a in enumerate(ATOMS)]))
    return raw.select(triples.alias("triples"), "y").select(F.sha1(F.to_json("triples")).alias("query_id"), "triples", "y")


def write_queries(queries: DataFrame, path: str) -> None:
    """One query a line, its patterns as arrays: what ``read_queries`` reads with ``lines``."""
    queries.select(F.transform("triples", lambda t: F.array(t["s"], t["p"], t["o"])).alias("triples"), "y").write.mode("overwrite").json(path)


def all_variable(triple: Column) -> Column:
    return is_variable(triple["s"]) & is_variable(triple["p"]) & is_variable(triple["o"])


def usable(queries: DataFrame, min_cardinality: int = 1) -> DataFrame:
    """Queries with results and without a pattern of variables only."""
    return queries.where((F.col("y") >= min_cardinality) & ~F.exists("triples", all_variable))


def at_most_uris(queries: DataFrame, k: int) -> DataFrame:
    """Queries none of whose patterns has more than k URIs."""
    uris = lambda t: F.size(F.filter(F.array(*[t[a] for a in ATOMS]), lambda x: x.startswith("<")))
    return queries.where(F.forall("triples", lambda t: uris(t) <= k))


def distinct_queries(queries: DataFrame) -> DataFrame:
    """One query of each ordered tuple of patterns, the first by id."""
    return queries.groupBy("triples").agg(F.min_by(F.struct("query_id", "y"), "query_id").alias("q")).select("q.query_id", "triples", "q.y")


def seeded(queries: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n queries in the order of a seeded hash."""
    return queries.orderBy(F.xxhash64(F.lit(seed), "query_id"), "query_id").limit(n)


def bound_atoms(queries: DataFrame) -> DataFrame:
    """query_id, pattern, slot (0 to 2), kind, term of every constant."""
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit("rel" if a == "p" else "ent").alias("kind"), F.col(f"t.{a}").alias("term")) for i, a in enumerate(ATOMS)])
    rows = queries.select("query_id", F.posexplode("triples").alias("pattern", "t")).select("query_id", "pattern", F.explode(slots).alias("x"))
    return rows.select("query_id", "pattern", "x.*").where(~is_variable(F.col("term")))


def shared_variables(queries: DataFrame) -> DataFrame:
    """query_id, i, j, n: the number of variables that two patterns of a query share."""
    names = queries.select("query_id", F.posexplode("triples").alias("i", "t")).select("query_id", "i", F.explode(F.array_distinct(F.filter(F.array(*[F.col(f"t.{a}") for a in ATOMS]), is_variable))).alias("v"))
    other = names.withColumnRenamed("i", "j")
    return names.join(other, ["query_id", "v"]).where("i <> j").groupBy("query_id", "i", "j").agg(F.count(F.lit(1)).alias("n"))


def combined(**sources: DataFrame) -> DataFrame:
    """All plans of several data sets, each labelled with its source."""
    out = None
    for name, plans in sources.items():
        part = plans.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def with_costs(plans: DataFrame) -> DataFrame:
    """Plans of finite, positive cost, with log_y."""
    y = F.col("y")
    return plans.where((y > 0) & ~F.isnan(y) & (y < float("inf"))).withColumn("log_y", F.ln(y))


def rank_groups(plans: DataFrame, least: int = 2) -> DataFrame:
    """Plans of groups with ``least`` plans and as many different costs."""
    good = plans.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("y").alias("k")).where((F.col("n") >= least) & (F.col("k") >= 2))
    return plans.join(good.select("group_id"), "group_id", "left_semi")


def split(plans: DataFrame, parts: int = 10, held: int = 0, seed: int = 0) -> DataFrame:
    """Adds ``held``: whole groups are held out, one part of ``parts``."""
    return plans.withColumn("held", F.pmod(F.xxhash64(F.lit(seed), "group_id"), F.lit(parts)) == held)


def rank_pairs(plans: DataFrame) -> DataFrame:
    """group_id, a, b: pairs of a group's plans (plan_id, y, prediction, n, rank) with different cost, the cheaper as a.

    n is the number of the group's plans, rank a plan's place by cost.
    """
    w = Window.partitionBy("group_id")
    ranked = plans.select("group_id", "plan_id", "y", "prediction", F.count(F.lit(1)).over(w).alias("n"), (F.row_number().over(w.orderBy("y", "plan_id")) - 1).alias("rank"))
    return pairs_within(ranked, ["group_id"], ["plan_id", "y", "prediction", "n", "rank"]).where(F.col("a.y") < F.col("b.y"))


def ranking_loss(plans: DataFrame, beta: float = 1.0) -> DataFrame:
    """Weighted pairwise logistic loss and accuracy by group; a pair weighs 1 / (1 + beta * the better rank)."""
    pairs = rank_pairs(plans)
    gap = F.col("b.prediction") - F.col("a.prediction")
    weight = 1 / (1 + beta * F.least("a.rank", "b.rank"))
    loss = F.greatest(-gap, F.lit(0.0)) + F.log1p(F.exp(-F.abs(gap)))
    return pairs.groupBy("group_id").agg((F.sum(weight * loss) / F.sum(weight)).alias("loss"), F.avg((gap > 0).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("pairs"))


def total_ranking_loss(plans: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """One row: the loss over all groups, where a pair also weighs (size of a's query * size of b's) ** (alpha / 2).

    ``plans`` has ``size``, the number of patterns of the plan's query.
    """
    pairs = pairs_within(plans.select("group_id", "plan_id", "y", "prediction", "size", (F.row_number().over(Window.partitionBy("group_id").orderBy("y", "plan_id")) - 1).alias("rank")), ["group_id"], ["plan_id", "y", "prediction", "size", "rank"]).where(F.col("a.y") < F.col("b.y"))
    gap = F.col("b.prediction") - F.col("a.prediction")
    weight = F.pow(F.col("a.size") * F.col("b.size"), F.lit(alpha / 2)) / (1 + beta * F.least("a.rank", "b.rank"))
    loss = F.greatest(-gap, F.lit(0.0)) + F.log1p(F.exp(-F.abs(gap)))
    return pairs.agg((F.sum(weight * loss) / F.sum(weight)).alias("loss"), F.avg((gap > 0).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("pairs"))


def contrast(plans: DataFrame, seed: int = 0) -> DataFrame:
    """One (good, bad) pair of plans with different cost of each group, by a seeded hash."""
    pairs = rank_pairs(plans)
    good, bad = F.col("a.plan_id"), F.col("b.plan_id")
    pick = F.min(F.struct(draw(seed, F.col("group_id"), good, bad).alias("at"), good.alias("good"), bad.alias("bad")))
    return pairs.groupBy("group_id").agg(pick.alias("x")).select("group_id", "x.good", "x.bad")


def quotas(strata: DataFrame, total: int, beta: float = 0.5) -> DataFrame:
    """stratum, n, quota: shares of ``total`` by n^beta, largest remainders first, never more than n."""
    weight = F.pow("n", F.lit(beta))
    shares = strata.crossJoin(F.broadcast(strata.agg(F.sum(weight).alias("_all"))))  # one row
    shares = shares.withColumn("_share", total * weight / F.col("_all")).withColumn("_floor", F.floor("_share"))
    left = shares.agg((F.lit(total) - F.sum("_floor")).alias("_left"))
    place = F.row_number().over(Window.orderBy((F.col("_share") - F.col("_floor")).desc(), "stratum"))  # a row for each stratum
    given = shares.crossJoin(F.broadcast(left)).withColumn("_extra", (place <= F.col("_left")).cast("long"))
    return given.select("stratum", "n", F.least("n", F.col("_floor") + F.col("_extra")).alias("quota"))


def block(rows: DataFrame, stratum: str, key: str, size: int, number: int, seed: int = 0) -> DataFrame:
    """The ``number``-th disjoint block of ``size`` rows of each shuffled stratum, wrapping around."""
    w = Window.partitionBy(stratum)
    at = F.row_number().over(w.orderBy(draw(seed, F.col(stratum), F.col(key)), key)) - 1
    numbered = rows.withColumn("_at", at).withColumn("_n", F.count(F.lit(1)).over(w))
    return numbered.where(F.pmod(F.col("_at") - number * size, F.col("_n")) < size).drop("_at", "_n")


def profile(plans: DataFrame) -> DataFrame:
    """Plans, groups and median log10 cost by source and number of cartesian joins."""
    return plans.groupBy("source", "cartesian").agg(F.count(F.lit(1)).alias("plans"), F.countDistinct("group_id").alias("groups"), F.median(F.log10("y")).alias("log10_y"))


def label_plans(plans: DataFrame) -> DataFrame:
    """Adds is_best: the cheapest plan of its group, the first among equals."""
    best = plans.groupBy("group_id").agg(F.min_by("plan_id", F.struct("y", "plan_id")).alias("_best"))
    return plans.join(best, "group_id").withColumn("is_best", F.col("plan_id") == F.col("_best")).drop("_best")


def verdicts(plans: DataFrame) -> DataFrame:
    """group_id, verdict: whether a cartesian plan beats the best plan without one.

    ``plans`` has group_id, cartesian, y, censored; a censored y is a lower bound.
    ``free``: no cartesian plan; ``unknown``: no plan without one has an exact cost,
    or a cartesian plan's bound is below the best of them; ``cartesian`` or
    ``connected``: the cheaper side, ``connected`` also where the bound of a
    censored cartesian plan is no lower than the best plan without; ``tie``.
    """
    cart, cens = F.col("cartesian") > 0, F.col("censored")
    s = plans.groupBy("group_id").agg(
        F.bool_or(cart).alias("has"),
        F.min(F.when(~cart & ~cens, F.col("y"))).alias("c"),
        F.min(F.when(cart & ~cens, F.col("y"))).alias("x"),
        F.min(F.when(cart & cens, F.col("y"))).alias("bound"),
    )
    x, c, bound = F.col("x"), F.col("c"), F.col("bound")
    verdict = F.when(~F.col("has"), "free").when(c.isNull(), "unknown").when(x < c, "cartesian").when(bound < c, "unknown").when(x == c, "tie").otherwise("connected")
    return s.select("group_id", verdict.alias("verdict"))


def expected_risk(plans: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Mean regret of each group's plans under softmax(alpha * score), and the best plan's share."""
    w = Window.partitionBy("group_id")
    p = F.exp(alpha * (F.col("prediction") - F.max("prediction").over(w)))
    rows = plans.withColumn("_p", p).withColumn("_regret", F.log10(F.greatest("y", F.lit(1.0))) - F.log10(F.greatest(F.min("y").over(w), F.lit(1.0))))
    return rows.groupBy("group_id").agg((F.sum(F.col("_p") * F.col("_regret")) / F.sum("_p")).alias("risk"), (F.sum(F.when(F.col("_regret") == 0, F.col("_p")).otherwise(0.0)) / F.sum("_p")).alias("best_share"))


def assembled(costs: DataFrame) -> DataFrame:
    """group_id, ord, edges, y, log_y, cartesian, size: costed orders (triples, ord, c_out, censored) as training plans.

    Plans of unknown or no cost are left out; a group is the ordered tuple of patterns.
    """
    names = names_of(F.col("triples"))
    group = F.sha1(F.to_json("triples")).alias("group_id")
    known = costs.where(~F.col("censored") & (F.col("c_out") > 0))
    y = F.col("c_out")
    return known.select(group, "ord", left_deep_edges(F.col("ord")).alias("edges"), y.alias("y"), F.ln(y.cast("double")).alias("log_y"), (cartesian_joins(F.col("ord"), names) > 0).alias("cartesian"), F.size("triples").alias("size"))


def write_plans(plans: DataFrame, path: str) -> None:
    """Plans stored by source, each source's groups together, so that one reads a data set or a group alone."""
    plans.repartitionByRange("source", "group_id").sortWithinPartitions("source", "group_id").write.mode("overwrite").partitionBy("source").parquet(path)


def read_plans(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    found = spark.read.parquet(path)
    return found if sources is None else found.where(F.col("source").isin(sources))
