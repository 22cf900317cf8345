"""Session helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.session import checkpoint_dir, durable

__all__ = ["checkpoint_dir", "documents", "durable", "join_counted", "remove_folder", "shuffle_partitions"]

#: Most keys that are joined by broadcast for being frequent, and rows that make a key frequent at least.
MOST_HOT, LEAST_HOT = 100_000, 1_000


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results, wherever it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def join_counted(rows: DataFrame, known: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """``rows`` joined with ``known``, which has one row for each key and in ``n`` the key's rows.

    Keys of more than ``total`` / MOST_HOT rows are MOST_HOT at most, so these are
    broadcast and their rows stay where they are; the others are shuffled.
    """
    limit = max(LEAST_HOT, total // MOST_HOT)
    values = [c for c in known.columns if c not in (key, n)]
    hot = known.where(F.col(n) > limit).select(key, *values, F.lit(True).alias("_hot"))
    both = rows.join(F.broadcast(hot), key, "left")
    rest = both.where("_hot IS NULL").select(*rows.columns).join(known.where(F.col(n) <= limit).drop(n), key)
    return both.where("_hot").drop("_hot").unionByName(rest)
