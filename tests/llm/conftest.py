import pytest

SCHEMA = "extra string, doc_id long, text string, lang string, source string, n_chars long, score double, key string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names clash with those that operators use inside."""

    def make(rows):
        full = [("x", *(list(r) + [None] * 4)[:4], len(r[1] or "") if len(r) > 1 else None, 0.5, "k") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in any column, empty, wordless and long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} of{i % 13}" for i in range(6000))
    a = " ".join(f"alpha{i}" for i in range(40))
    return make_docs([
        (1, a, "en", "s1"), (2, a, "en", "s1"), (2, a, "en", "s1"), (3, "z z " + a + " end", "en", "s2"), (4, None, "en", "s2"), (5, "", None, None), (6, " \n\t ", "fr", "s3"),
        (7, long, "en", "s1"), (8, long + " tail", "fr", None), (None, a, "en", "s1"), (9, "x", "de", "s1"), (10, "same " * 60, "de", "s3"), (11, "İstanbul \U0001f600 é ß", "de", "s3"), (12, None, None, None),
    ])
