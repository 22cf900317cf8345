"""Where intermediate results are written, so that a lost executor costs no more than its own tasks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a private one only where that is unset and the master local, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tripleloom-checkpoint-"))
    return named or sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` where every executor can read it back."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
