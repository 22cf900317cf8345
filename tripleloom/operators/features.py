"""Features of the terms of queries' patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.plans.table import is_variable


def pattern_features(queries: DataFrame, vectors: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """query_id, pattern, slot (0 to 2), variable, embedding, n of every term of the queries (query_id, triples).

    A variable has its number (by first appearance in the query), a vector of ones
    and n = 0. A constant has number 0, its vector of ``vectors`` (term, embedding),
    zeros if it has none, and its count of ``counts`` (term, n), 1 if unknown. Only
    terms that occur in the queries are looked up, so a large graph's terms are
    never joined whole.
    """
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(f"t.{a}").alias("term")) for i, a in enumerate("spo")])
    rows = queries.select("query_id", F.posexplode("triples").alias("pattern", "t")).select("query_id", "pattern", F.explode(slots).alias("x")).select("query_id", "pattern", "x.*")
    first = F.min(F.col("pattern") * 3 + F.col("slot")).over(Window.partitionBy("query_id", "term"))
    number = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.when(is_variable(F.col("term")), F.col("_first")).otherwise(F.lit(1 << 30)))) - 1
    rows = rows.withColumn("_first", first).withColumn("variable", F.when(is_variable(F.col("term")), number).otherwise(0).cast("int"))
    terms = rows.where(~is_variable(F.col("term"))).select("term").distinct()
    known = terms.join(vectors.join(terms, "term", "left_semi"), "term", "left").join(counts.join(terms, "term", "left_semi"), "term", "left")
    flat = lambda x: F.array_repeat(F.lit(x), size)
    variable = is_variable(F.col("term"))
    joined = rows.join(known, "term", "left")
    return joined.select("query_id", "pattern", "slot", "variable", F.when(variable, flat(1.0)).otherwise(F.coalesce("embedding", flat(0.0))).alias("embedding"), F.when(variable, 0).otherwise(F.coalesce("n", F.lit(1))).cast("long").alias("n"))
