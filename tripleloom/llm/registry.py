"""The registered queries of the text operators, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tripleloom.llm._session import documents

TOKENIZER = "word_bpe_49k.json"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tripleloom.llm.fingerprints import edited_copies

    return edited_copies(documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tripleloom.llm.line_dedup import line_report

    return line_report(documents(spark, sf_dir))


#: Cleaned texts of a table ``{docs}``; also a stage of the pipeline's SQL.
LINES_SQL = r"""
SELECT d.doc_id, d.source, i - 1 AS pos, d.lines[i] AS line, trim(d.lines[i], E' \t\r\f\x0B') AS bare
FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM {docs}) AS d, unnest(range(1, len(d.lines) + 1)) AS t(i)
"""
OP2_SQL = f"""
WITH lines AS ({LINES_SQL.format(docs="documents")}),
spread AS (
  SELECT bare, min((doc_id, pos)) AS first FROM lines WHERE length(bare) >= 16
  GROUP BY bare HAVING count(DISTINCT source) >= 10
), marked AS (
  SELECT l.*, (s.bare IS NOT NULL AND (l.doc_id, l.pos) <> s.first) AS gone
  FROM lines AS l LEFT JOIN spread AS s ON s.bare = l.bare
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents AS d LEFT JOIN kept AS k ON k.doc_id = d.doc_id
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tripleloom.llm.license_scan import license_report

    return license_report(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tripleloom.llm.language_id import identify

    return identify(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tripleloom.llm.packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tripleloom.llm.decontaminate import find_leaks

    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP6_SQL = r"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), w AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM t
), s AS (
  SELECT DISTINCT kind, id, array_to_string(words[i : i + 4], ' ') AS shingle
  FROM w, unnest(range(1, len(words) - 3)) AS u(i) WHERE len(words) >= 5
), sizes AS (
  SELECT id AS item_id, count(*) AS n_shingles FROM s WHERE kind = 'b' GROUP BY id
), shared AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared
  FROM s AS b JOIN s AS d ON b.shingle = d.shingle AND b.kind = 'b' AND d.kind = 'd' GROUP BY d.id, b.id
)
SELECT doc_id, item_id, n_shared, n_shingles, CAST(n_shared AS DOUBLE) / n_shingles AS containment
FROM shared JOIN sizes USING (item_id) WHERE n_shared >= 0.8 * n_shingles
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tripleloom.llm.quality import classify

    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tripleloom.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tripleloom.llm.token_counts import token_counts

    return token_counts(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tripleloom.llm.substring_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir), with_text=False)


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS seq
  FROM d, unnest(range(1, len(words) - 11)) AS t(i)
  WHERE len(words) >= 13
), f AS (
  SELECT seq, min(doc_id) AS first_doc FROM w GROUP BY seq HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT w.doc_id, k
  FROM w JOIN f ON w.seq = f.seq AND w.doc_id > f.first_doc, unnest(range(w.i, w.i + 13)) AS t(k)
), kept AS (
  SELECT d.doc_id, count(g.k) AS n_removed, string_agg(d.word, ' ' ORDER BY d.pos) FILTER (WHERE g.k IS NULL) AS text
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d) AS d
  LEFT JOIN gone AS g ON g.doc_id = d.doc_id AND g.k = d.pos
  GROUP BY d.doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept AS k ON k.doc_id = d.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_line_dedup": op2_line_dedup,
        "op3_license_scan": op3_license_scan,
        "op4_language_id": op4_language_id,
        "op5_packing": op5_packing,
        "op6_decontamination": op6_decontamination,
        "op7_quality": op7_quality,
        "op8_simhash": op8_simhash,
        "op9_token_counts": op9_token_counts,
        "op10_substring_dedup": op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": OP2_SQL,
        "op6_decontamination": OP6_SQL,
        "op10_substring_dedup": OP10_SQL,
    }
