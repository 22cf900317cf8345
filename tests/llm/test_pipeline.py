import random

import corpus_pipeline
import pytest

import __spark_entry__


@pytest.fixture(scope="module")
def folder(spark, docs_of, tmp_path_factory):
    """A small corpus with junk, boilerplate, copies and leaks."""
    rng = random.Random(7)
    words = [f"{a}{b}" for a in "the of and to in that was".split() for b in "er ing ed ly st".split()] + "the of and to in".split()
    rows, item = [], " ".join(rng.choice(words) for _ in range(40))
    for i in range(120):
        t = " ".join(rng.choice(words) for _ in range(120))
        if i % 10 == 1:
            t = " ".join(w + "###" for w in t.split())
        if i % 10 == 2:
            t = rows[i - 2][1]
        if i % 10 == 3:
            t = t + " " + item
        rows.append((i, t + "\nAll pages of this site are made with care.", "en", f"s{i % 12}"))
    path = str(tmp_path_factory.mktemp("corpus"))
    docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 1), 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_each_stage_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        left.append({r.doc_id: r.text for r in docs.collect()})
    clean = {i for i in range(120) if i % 10 in (0, 4, 5, 6, 7, 8, 9)}
    assert set(left[0]) == {i for i in range(120) if i % 10 != 1}
    assert set(left[1]) == set(left[0]) and sum("made with care" in t for t in left[1].values()) == 1
    assert set(left[2]) == {i for i in range(120) if i % 10 not in (1, 2)}
    assert set(left[3]) == clean


def test_run_packs_what_is_left(spark, folder):
    found = __spark_entry__.queries()["pipeline"](spark, folder).collect()
    assert {r.doc_id for r in found} == {i for i in range(120) if i % 10 in (0, 4, 5, 6, 7, 8, 9)}
    assert all(sum(x.length for x in found if x.doc_id == r.doc_id) == r.doc_tokens for r in found)


def test_stages_on_odd_and_empty_tables(spark, docs_of, folder):
    """Nulls, repeated rows, very long and short texts, extra columns with clashing names, an empty table."""
    from tests.llm.conftest import ODD

    for docs in (docs_of(ODD), docs_of(ODD).where("false")):
        columns, n = docs.columns, docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == columns and docs.count() <= n
        packed = corpus_pipeline.packing(spark, docs, folder)
        assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_rows_without_an_id_are_told_apart_by_text(docs_of):
    a, b = "one of the many texts that are here twice or more often", "quite another text of which there are only copies without an id"
    rows = [(1, a), (None, a), (None, b), (None, b + " "), (None, "alone and without any id at all in here"), (5, None), (None, None)]
    kept = sorted(((r.doc_id or 99, (r.text or "").strip()) for r in corpus_pipeline.near_dedup(None, docs_of(rows), "").collect()))
    assert kept == [(1, a), (5, ""), (99, "alone and without any id at all in here"), (99, b)]
