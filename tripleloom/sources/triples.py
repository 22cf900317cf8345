"""Knowledge graphs as a DataFrame of distinct (s, p, o) string triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One N-Triples statement: subject, predicate, the rest up to the closing dot.
STATEMENT = r"^\s*(\S+)\s+(\S+)\s+(.*?)\s*\.\s*$"


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of N-Triples files; blank lines and comments are skipped, literals may hold spaces."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)") & F.col("value").rlike(STATEMENT))
    return lines.select(*(F.regexp_extract("value", STATEMENT, i).alias(c) for i, c in enumerate("spo", 1))).distinct()


def term(kind: str, key: Column) -> Column:
    """The term ``<kind/key>``."""
    return F.concat(F.lit(f"<{kind}/"), key.cast("string"), F.lit(">"))


#: predicate: (table, subject kind and column, object kind and column)
MAPPING = {
    "c_nation": ("customer", ("customer", "c_custkey"), ("nation", "c_nationkey")),
    "c_segment": ("customer", ("customer", "c_custkey"), ("segment", "c_mktsegment")),
    "s_nation": ("supplier", ("supplier", "s_suppkey"), ("nation", "s_nationkey")),
    "n_region": ("nation", ("nation", "n_nationkey"), ("region", "n_regionkey")),
    "o_customer": ("orders", ("order", "o_orderkey"), ("customer", "o_custkey")),
    "o_status": ("orders", ("order", "o_orderkey"), ("status", "o_orderstatus")),
    "o_priority": ("orders", ("order", "o_orderkey"), ("priority", "o_orderpriority")),
    "has_part": ("lineitem", ("order", "l_orderkey"), ("part", "l_partkey")),
    "has_supplier": ("lineitem", ("order", "l_orderkey"), ("supplier", "l_suppkey")),
    "p_brand": ("part", ("part", "p_partkey"), ("brand", "p_brand")),
    "p_type": ("part", ("part", "p_partkey"), ("type", "p_type")),
}


#: Rows of a table that one task makes triples of; what follows in that task is bounded with it.
ROWS_A_TASK = 300_000


def parts_of(rows: int) -> int:
    return max(1, -(-rows // ROWS_A_TASK))


def triples_of(spark: SparkSession, sf_dir: str, predicate: str, parts: int | None = None, ranges: bool = False) -> DataFrame:
    """The distinct triples of one predicate of the relational tables, in ``parts`` that grow with the table.

    ``ranges``: dealt by ranges of subject and object, so a subject's triples lie together, of a hub in several
    parts; what is counted by subject is then small before it is shuffled. The keys are read once more for this.
    """
    table, (s_kind, s_col), (o_kind, o_col) = MAPPING[predicate]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    parts = parts or parts_of(rows.count())  # of the files' footers
    rows = rows.select(s_col, o_col).na.drop()
    rows = (rows.repartitionByRange if ranges else rows.repartition)(parts, s_col, o_col).distinct()
    return rows.select(term(s_kind, F.col(s_col)).alias("s"), F.lit(f"<{predicate}>").alias("p"), term(o_kind, F.col(o_col)).alias("o"))


def rows_of(spark: SparkSession, sf_dir: str, predicates: list[str] | None = None) -> dict[str, int]:
    """Rows of each predicate's table, from which its triples are made."""
    names = list(predicates or MAPPING)
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in sorted({MAPPING[p][0] for p in names})}
    return {p: rows[MAPPING[p][0]] for p in names}


def told_apart(spark: SparkSession, sf_dir: str, predicates: list[str] | None = None) -> bool:
    """Whether no subject of the tables' graph can hold a space, its key being a whole number: no two triples then have the same text."""
    keys = {(table, column) for table, (_, column), _ in (MAPPING[p] for p in predicates or MAPPING)}
    types = {t: dict(spark.read.parquet(f"{sf_dir}/{t}.parquet").dtypes) for t in sorted({t for t, _ in keys})}
    return all(types[t][c] in ("tinyint", "smallint", "int", "bigint") for t, c in keys)


def graph_of(spark: SparkSession, sf_dir: str, predicates: list[str] | None = None, ranges: bool = False) -> DataFrame:
    """Relational tables mapped to a knowledge graph; predicates are disjoint, so each is made distinct alone; ``ranges`` as of ``triples_of``."""
    rows = rows_of(spark, sf_dir, predicates)
    parts = [triples_of(spark, sf_dir, p, parts_of(n), ranges) for p, n in rows.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def mapping_sql(predicates: list[str] | None = None) -> str:
    """The same graph as SQL over the tables."""
    select = "SELECT DISTINCT '<{sk}/' || {sc} || '>' AS s, '<{p}>' AS p, '<{ok}/' || {oc} || '>' AS o FROM {t} WHERE {sc} IS NOT NULL AND {oc} IS NOT NULL"
    return " UNION ALL ".join(select.format(p=p, t=t, sk=s[0], sc=s[1], ok=o[0], oc=o[1]) for p, (t, s, o) in MAPPING.items() if predicates is None or p in predicates)


def write_graph(kg: DataFrame, path: str) -> None:
    """Store a graph by predicate, sorted by subject: a bound predicate reads its own folder only, written by many tasks."""
    kg.repartitionByRange("p", "s").sortWithinPartitions("p", "s").write.mode("overwrite").partitionBy("p").parquet(path)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("s", "p", "o")
