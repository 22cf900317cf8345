"""Cross-site boilerplate lines, found by their spread over distinct sites.

A line's spread is the number of distinct sites it occurs on. Each task sketches
the sites of its lines by HyperLogLog; the sketches of a line hash merge by
aggregation, so a line on a third of all rows sends one sketch a task. Lines
whose estimate lies within ``margin`` of the threshold get an exact distinct
count, the others are settled by the estimate. A line on ``min_sites`` sites or
more is boilerplate: it stays once, where the smallest doc_id has it first, and
goes everywhere else.

Lines are separated by line feeds and compared without the white space around
them. Lines of fewer than ``min_chars`` characters are never boilerplate.

Defined results: null text stays null and has no lines; a null site counts as
none; a null doc_id sorts after all others; rows that repeat a doc_id with the
same text lose the same lines; of different texts under one doc_id, or without
any, that have a line equally early, the one with the smallest text hash keeps
it. Extra columns pass through; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm._session import durable

LAST = (1 << 63) - 1
#: Most rows of a table that is broadcast; a row is a few numbers.
BROADCAST_ROWS = 500_000
#: Parts into which each key is split where the other side is too large for that.
SALTS = 32
#: Lines whose removed positions are looked up together.
BLOCK = 256


def hashed_lines(docs: DataFrame, site: str, min_chars: int) -> DataFrame:
    """owner, version, pos, line_hash, site of every line that may be boilerplate."""
    lines = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("owner"), F.xxhash64("text").alias("version"), F.col(site).cast("string").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    trimmed = F.regexp_replace("line", r"^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$", "")
    return lines.withColumn("line", trimmed).where(F.length("line") >= min_chars).select("owner", "version", "pos", "site", F.xxhash64("line").alias("line_hash"))


def on_lines(lines: DataFrame, known: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``lines`` with the columns of ``known`` (a written table, one row for each line_hash), for the hashes in both.

    Up to ``most`` rows ``known`` is broadcast; beyond that it is repeated for
    each of some salts, so that a common line's rows are dealt over many tasks.
    """
    if known.count() <= most:
        return lines.join(F.broadcast(known), "line_hash")
    salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("_salt", F.pmod(F.xxhash64("owner", "version", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["line_hash", "_salt"]).drop("_salt")


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int, margin: float, most: int = BROADCAST_ROWS) -> DataFrame:
    """line_hash and the first place of every line on ``min_sites`` sites or more."""
    first = F.min(F.struct("owner", "pos", "version")).alias("first")
    sketch = F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch")
    # fewer rows than min_sites are on fewer sites
    spread = lines.groupBy("line_hash").agg(F.count(F.lit(1)).alias("n"), sketch, first).where(F.col("n") >= min_sites)
    spread = spread.select("line_hash", F.hll_sketch_estimate("sketch").alias("sites"), "first")
    near = F.abs(F.col("sites") - min_sites) <= F.lit(margin * min_sites)
    spread = durable(spread.where(near | (F.col("sites") >= min_sites)).withColumn("near", near))
    some = on_lines(lines.select("line_hash", "site", "owner", "version", "pos"), spread.where("near").select("line_hash"), most)
    exact = some.groupBy("line_hash", "site").agg(F.lit(1).alias("one")).groupBy("line_hash").agg(F.count("site").alias("exact"))
    settled = spread.join(exact, "line_hash", "left")
    chosen = ~F.col("near") | (F.coalesce("exact", F.lit(0)) >= min_sites)
    return durable(settled.where(chosen).select("line_hash", "first"))


def drop_boilerplate(docs: DataFrame, min_sites: int = 10, site: str = "source", min_chars: int = 16, lg_k: int = 12, margin: float = 0.25, most_broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with boilerplate lines out of ``text``, then _n_lines and _n_removed as the last two columns."""
    lines = durable(hashed_lines(docs, site, min_chars))
    found = boilerplate(lines, min_sites, lg_k, margin, most_broadcast)
    gone = on_lines(lines.drop("site"), found, most_broadcast).where(F.struct("owner", "pos", "version") != F.col("first"))
    # positions by blocks, so that a look-up stays short in texts of very many lines
    gone = gone.groupBy("owner", "version", F.floor(F.col("pos") / BLOCK).cast("int").alias("block")).agg(F.collect_set("pos").alias("at"))
    gone = gone.groupBy("owner", "version").agg(F.map_from_entries(F.collect_list(F.struct("block", "at"))).alias("gone"), F.sum(F.size("at")).alias("n_removed"))
    # the row travels as one struct, so that no name of its columns can clash
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("owner"), F.xxhash64("text").alias("version"))
    joined = keyed.join(gone.hint("shuffle_hash"), ["owner", "version"], "left")
    text, split = F.col("row.text"), F.split("row.text", "\n")
    stays = lambda _, i: ~F.coalesce(F.array_contains(F.element_at("gone", F.floor(i / BLOCK).cast("int")), i), F.lit(False))
    rebuilt = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.filter(split, stays), "\n"))
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(split)).cast("long")
    columns = [rebuilt.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return joined.select(*columns, n_lines.alias("_n_lines"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("_n_removed"))


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 of every row."""
    out = drop_boilerplate(docs.select("doc_id", "text", options.get("site", "source")), **options)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
