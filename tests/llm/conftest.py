import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, version string, pos string, row string, owner string, fp string, place string, people string, removed string, _text string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text[, lang, source]) rows, with extra columns whose names may clash."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", len(r[1] or ""), *["x"] * 9) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(60_000))
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf", "en", "s1"),
    (2, None, None, None),
    (3, "", "en", "s1"),
    (4, " \n\t ", "de", "s2"),
    (None, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf", "en", "s3"),
    (5, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf", None, "s1"),
    (5, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf", None, "s1"),
    (6, "Ünïcödé wörds — 漢字 и кириллица 😀 ok", "de", "s2"),
    (7, LONG, "en", "s4"),
    (8, "x" * 50_000, "en", "s4"),
    (9, "one two <|endoftext|> three", "en", "s1"),
    (10, "***", "en", "s1"),
]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
