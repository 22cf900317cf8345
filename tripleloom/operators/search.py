"""Searches for cheap orders over known sizes, for all queries of a table side by side.

``cards`` has query_id, mask (a bit for each pattern), card: the size of each set
of a query's patterns. A step extends every kept prefix by every pattern left and
is one join with ``cards``; the cost grows by the size of each join. Ties go to
the lexicographically first order. A set without a known size is never taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _start(cards: DataFrame) -> tuple[DataFrame, int]:
    """(query_id, n, mask, ord, cost, rank of every single pattern; the largest n)."""
    known = cards.where(F.col("card").isNotNull() & (F.bit_count("mask") == 1))
    sizes = cards.groupBy("query_id").agg(F.max(F.length(F.bin("mask"))).cast("int").alias("n"))
    number = (F.length(F.bin("mask")) - 1).cast("int")
    largest = sizes.agg(F.max("n")).first()[0] or 0
    return known.join(sizes, "query_id").select("query_id", "n", "mask", F.array(number).alias("ord"), F.lit(0).cast("decimal(38,0)").alias("cost"), F.col("card").alias("rank")), largest


def _grown(states: DataFrame, cards: DataFrame) -> DataFrame:
    left = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: ~F.array_contains("ord", i))
    more = states.where(F.size("ord") < F.col("n")).select("query_id", "n", "mask", "ord", "cost", F.explode(left).alias("i"))
    more = more.withColumn("mask", F.col("mask") + F.call_function("shiftleft", F.lit(1), F.col("i")))
    found = more.join(cards.where("card IS NOT NULL").select("query_id", "mask", "card"), ["query_id", "mask"])
    cost = (F.col("cost") + F.col("card")).cast("decimal(38,0)")
    return found.select("query_id", "n", "mask", F.concat("ord", F.array("i")).alias("ord"), cost.alias("cost"), cost.alias("rank"))


def beam(cards: DataFrame, width: int, worst: bool = False) -> DataFrame:
    """query_id, ord, cost: the ``width`` best orders that a beam of that width keeps; width 1 is greedy search."""
    states, largest = _start(cards)
    by_rank = F.col("rank").desc() if worst else F.col("rank").asc()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(by_rank, "ord"))
    keep = lambda df: df.withColumn("_place", place).where(F.col("_place") <= width).drop("_place")
    states = keep(states)
    for _ in range(largest - 1):
        states = keep(_grown(states, cards).unionByName(states.where(F.size("ord") == F.col("n"))))
    return states.where(F.size("ord") == F.col("n")).select("query_id", "ord", "cost")


def dynamic(cards: DataFrame) -> DataFrame:
    """query_id, ord, cost: the cheapest order of each query, by the cheapest way to each set of patterns."""
    states, largest = _start(cards)
    for _ in range(largest - 1):
        grown = _grown(states, cards).unionByName(states.where(F.size("ord") == F.col("n")))
        states = grown.groupBy("query_id", "n", "mask").agg(F.min(F.struct("cost", "ord")).alias("x")).select("query_id", "n", "mask", "x.ord", "x.cost", F.col("x.cost").alias("rank"))
    return states.where(F.size("ord") == F.col("n")).select("query_id", "ord", "cost")
