"""Pairs of rows of one group, whatever the groups' sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs_within(rows: DataFrame, group: list[str], columns: list[str], size: int = 2000) -> DataFrame:
    """group, a, b: every two rows of a group (a row with itself too), as structs of ``columns``.

    A group of n rows is dealt over ceil(n / size) parts of its first sides, each
    of which meets all second sides, so no task holds all pairs of a large group.
    """
    side = F.struct(*columns)
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    parts: Column = F.ceil(F.col("_n") / size).cast("int")
    dealt = rows.select(*group, side.alias("_x")).join(sizes, group).withColumn("_parts", parts)
    first = dealt.select(*group, F.col("_x").alias("a"), F.pmod(F.xxhash64("_x"), F.col("_parts")).cast("int").alias("_part"))
    second = dealt.select(*group, F.col("_x").alias("b"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    return first.join(second, [*group, "_part"]).drop("_part")
