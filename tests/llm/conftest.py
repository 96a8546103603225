import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of texts, ids counting from 0 unless given as pairs; with an extra column that clashes with results."""

    def make(texts, extra=True):
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
        data = [(i, t, "en", "a", None if t is None else len(t), 7.0) for i, t in rows]
        df = spark.createDataFrame(data, DOC + ", score double")
        return df if extra else df.drop("score")

    return make


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
