"""From raw documents to packed training sequences, one text operator a stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
its result is written as Parquet and read again as the next one's ``docs``. All
but the last return the columns of ``documents``.

Defined results of every stage: extra columns pass through, whatever their names
(but for packing, which returns pieces); an empty table stays empty; repeated rows
are judged alike, so near_dedup keeps rows that repeat a doc_id together. Null
text counts as empty: it has no lines and no shingles, near_dedup keeps one of
several empty texts, and packing gives it its closing id alone. Rows without a
doc_id are told apart by their text; near_dedup keeps one of several equal ones,
and none where a document with an id is alike.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.llm._session import checkpoint_dir, documents, remove_folder
from tripleloom.llm.decontaminate import drop_leaks
from tripleloom.llm.line_dedup import drop_boilerplate
from tripleloom.llm.packing import pack
from tripleloom.llm.quality import keep_good
from tripleloom.llm.simhash import one_of_each


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go from the texts; n_chars follows."""
    cleaned = drop_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a likeness of 0.8 or more stays, the one of the smallest doc_id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is a written table in the shared folder.

    A stage's table goes when the next one's is written; the last one's stays,
    since the result reads it.
    """
    docs = documents(spark, sf_dir)
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{folder}/{name}"
    return docs
