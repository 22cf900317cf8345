"""Statistics of a graph: occurrences, degrees, factor-graph edges and neighbourhoods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.plans.bgp import Pattern
from tripleloom.plans.table import draw
from tripleloom.session import durable


def term_occurrences(kg: DataFrame) -> DataFrame:
    """term, n: occurrences over all roles."""
    return kg.select(F.explode(F.array("s", "p", "o")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def role_occurrences(kg: DataFrame) -> DataFrame:
    """term, n_s, n_p, n_o: occurrences by role."""
    roles = kg.select(F.explode(F.array(*[F.struct(F.col(c).alias("term"), F.lit(c).alias("role")) for c in "spo"])).alias("x")).select("x.*")
    return roles.groupBy("term").agg(*[F.count_if(F.col("role") == c).alias(f"n_{c}") for c in "spo"])


def predicate_degrees(kg: DataFrame, column: str, parts: int | None = None) -> DataFrame:
    """p, column, d: triples of each; dealt over ``parts`` tasks, or without as the session deals its shuffles."""
    rows = kg.select("p", column)
    rows = rows.repartition(parts, "p", column) if parts else rows
    return rows.groupBy("p", column).agg(F.count(F.lit(1)).alias("d"))


def predicate_stats(kg: DataFrame, parts: int | None = None) -> DataFrame:
    """p, count, n_subj, n_obj, max_out, max_in; degrees by two-level aggregation, so no predicate's rows meet in one task.

    Subjects are nearly as many as triples, so they are dealt over ``parts``; objects
    are fewer and some of them frequent, so they are counted before they are dealt.
    """

    def side(column: str, distinct: str, most: str, parts: int | None = None) -> DataFrame:
        return predicate_degrees(kg, column, parts).groupBy("p").agg(F.sum("d").alias("count"), F.count(F.lit(1)).alias(distinct), F.max("d").alias(most))

    return side("s", "n_subj", "max_out", parts).join(side("o", "n_obj", "max_in").drop("count"), "p").select("p", "count", "n_subj", "n_obj", "max_out", "max_in")


def top_predicates(stats: DataFrame, k: int = 5) -> DataFrame:
    return stats.orderBy(F.desc("max_out"), "p").limit(k)


#: Roles of the six directed edges of a triple's node.
ROLES = ("s_t", "p_t", "o_t", "t_s", "t_p", "t_o")


def factor_graph(kg: DataFrame) -> DataFrame:
    """src, dst, role: six directed edges between each triple and its terms."""
    node = F.concat(F.lit("t:"), F.sha1(F.concat_ws(" ", "s", "p", "o")))
    name = {"s": F.concat(F.lit("e:"), "s"), "p": F.concat(F.lit("r:"), "p"), "o": F.concat(F.lit("e:"), "o")}
    edges = [F.struct(name[c].alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(f"{c}_t").alias("role")) for c in "spo"]
    edges += [F.struct(F.lit(None).cast("string").alias("src"), name[c].alias("dst"), F.lit(f"t_{c}").alias("role")) for c in "spo"]
    return kg.select(node.alias("t"), F.explode(F.array(*edges)).alias("e")).select(F.coalesce("e.src", "t").alias("src"), F.coalesce("e.dst", "t").alias("dst"), "e.role")


def write_factor_graph(edges: DataFrame, path: str) -> None:
    """Edges stored by source, so that a node's neighbours lie together."""
    edges.repartition("src").sortWithinPartitions("src", "role").write.mode("overwrite").parquet(path)


def node_features(kg: DataFrame) -> DataFrame:
    """term, log1p of its occurrences by role, and whether it is a relation."""
    return role_occurrences(kg).select("term", *[F.log1p(F.col(f"n_{c}").cast("double")).alias(f"log_{c}") for c in "spo"], (F.col("n_p") > 0).alias("is_relation"))


def factor_degrees(kg: DataFrame, apart: bool = False) -> DataFrame:
    """src, degree: ``degrees`` of ``factor_graph``, whose six edges a triple are not made: three are the triple's own, one each its terms'.

    ``apart``: triples are distinct and no two have the same text (as where no subject or predicate holds a
    space), so the node of each has its three edges and no more; these nodes are then neither grouped nor shuffled.
    """
    ends = [F.struct(F.concat(F.lit(f"{kind}:"), c).alias("src"), F.lit(1).cast("long").alias("n")) for c, kind in zip("spo", "ere", strict=True)]
    node = F.struct(F.concat(F.lit("t:"), F.sha1(F.concat_ws(" ", "s", "p", "o"))).alias("src"), F.lit(3).cast("long").alias("n"))
    grouped = ends if apart else [*ends, node]
    counted = kg.select(F.explode(F.array(*grouped)).alias("x")).groupBy("x.src").agg(F.sum("x.n").alias("degree"))
    return counted.unionByName(kg.select(node["src"].alias("src"), node["n"].alias("degree"))) if apart else counted


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


#: Nodes that are broadcast at most.
FEW_NODES = 1_000_000


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int, cap: int | None = None, seed: int = 0) -> DataFrame:
    """src, dst, role, hop, weight: edges within ``hops`` of the seeds (column node).

    With a ``cap`` each node keeps that many edges, drawn by a hash of the seed
    and the edge, with weight max(1, degree / cap); an edge keeps its first hop.
    """
    frontier = seeds.select(F.col("node")).distinct()
    reached, found = frontier, None
    for hop in range(1, hops + 1):
        # a frontier of bounded size goes to the edges, which then stay where they are
        near = F.broadcast(frontier) if frontier.count() <= FEW_NODES else frontier
        step = edges.join(near, edges.src == near.node, "left_semi")
        if cap is not None:
            step = capped(step, cap, seed)
        else:
            step = step.withColumn("weight", F.lit(1.0))
        step = durable(step.withColumn("hop", F.lit(hop)))  # read twice, and the next hop's plan starts here
        found = step if found is None else found.unionByName(step)
        frontier = durable(step.select(F.col("dst").alias("node")).distinct().join(reached, "node", "left_anti"))
        reached = reached.unionByName(frontier)
    return found.groupBy("src", "dst", "role").agg(F.min("hop").alias("hop"), F.min_by("weight", "hop").alias("weight"))


def capped(edges: DataFrame, cap: int, seed: int, size: int = 100_000) -> DataFrame:
    """At most ``cap`` drawn edges of each source, with weight max(1, degree / cap).

    The edges of a hub are first numbered in parts of about ``size``, whose first
    ``cap`` are numbered again: no task sorts all edges of a node.
    """
    by = Window.partitionBy("src")
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("_degree"))
    at = draw(seed, F.col("src"), F.col("dst"), F.col("role"))
    dealt = edges.join(degree, "src").withColumn("_at", at).withColumn("_part", F.pmod(F.xxhash64("dst", "role"), F.ceil(F.col("_degree") / size)))
    order = ("_at", "dst", "role")
    some = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("src", "_part").orderBy(*order))).where(F.col("_n") <= cap)
    kept = some.withColumn("_n", F.row_number().over(by.orderBy(*order))).where(F.col("_n") <= cap)
    return kept.withColumn("weight", F.greatest(F.lit(1.0), F.col("_degree") / F.lit(float(cap)))).drop("_n", "_at", "_part", "_degree")


def bound_terms(kg: DataFrame, patterns: Sequence[Pattern], parts: int | None = None) -> DataFrame:
    """term, n_s, n_o, n_p, max_out, max_in of every constant of the patterns; unknown ones count 0; ``parts`` as of ``predicate_stats``."""
    terms = sorted({t for p in patterns for t in (p.s, p.p, p.o) if not t.startswith("?")})
    wanted = F.broadcast(kg.sparkSession.createDataFrame([(t,) for t in terms], "term string"))
    named = [F.col(c).isin(terms) for c in "spo"]  # a pattern's few constants
    roles = role_occurrences(kg.where(named[0] | named[1] | named[2])).where(F.col("term").isin(terms))  # not of all that they meet
    some = wanted.join(roles, "term", "left").join(predicate_stats(kg.where(named[1]), parts).select(F.col("p").alias("term"), "max_out", "max_in"), "term", "left")
    return some.select("term", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_s", "n_p", "n_o", "max_out", "max_in")])


def random_walks(edges: DataFrame, depth: int = 4, per_node: int = 10, seed: int = 0) -> DataFrame:
    """walk_id, path: ``per_node`` walks from every source over a graph (s, p, o).

    Each step is one join with the numbered out-edges of the walk's end, chosen by a hash.
    """
    # numbered in parts of bounded size, with the sizes of the parts before: no task sorts all edges of a hub
    part = F.pmod(F.xxhash64("p", "o"), F.ceil(F.col("_n") / 100_000))
    dealt = edges.select("s", "p", "o").join(edges.groupBy("s").agg(F.count(F.lit(1)).alias("_n")), "s").withColumn("_part", part)
    before = dealt.groupBy("s", "_part").agg(F.count(F.lit(1)).alias("_k"))
    before = before.select("s", "_part", F.coalesce(F.sum("_k").over(Window.partitionBy("s").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("s", "_part").orderBy("p", "o")) - 1
    numbered = dealt.withColumn("_i", place).join(before, ["s", "_part"]).select("s", "p", "o", (F.col("_i") + F.col("_before")).alias("i"))
    sizes = edges.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    walks = sizes.select(F.col("s").alias("end"), F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("k"))
    walks = walks.select(F.concat_ws("#", "end", "k").alias("walk_id"), "end", F.array("end").alias("path"))
    for hop in range(depth):
        at = walks.join(sizes, walks.end == sizes.s, "left").drop("s").withColumn("i", F.pmod(F.xxhash64(F.lit(seed), F.lit(hop), "walk_id"), F.col("n")))
        walks = at.join(numbered.select(F.col("s").alias("end"), "i", "p", "o"), ["end", "i"], "left").select("walk_id", F.coalesce("o", "end").alias("end"), F.when(F.col("o").isNull(), F.col("path")).otherwise(F.concat("path", F.array("p", "o"))).alias("path"))
    return walks.select("walk_id", "path")


def walk_embeddings(walks: DataFrame, size: int = 100, rounds: int = 10, seed: int = 0):
    """A Word2Vec model over random walks."""
    from pyspark.ml.feature import Word2Vec

    return Word2Vec(vectorSize=size, maxIter=rounds, minCount=1, seed=seed, inputCol="path", outputCol="vector").fit(walks)
