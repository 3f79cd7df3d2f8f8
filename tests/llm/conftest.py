import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make_docs(spark):
    """A documents table of texts; a pair gives its doc_id."""

    def make(texts, extra=False):
        rows = [(*t, "en", "s", 0) if isinstance(t, tuple) else (i, t, "en", "s", 0) for i, t in enumerate(texts)]
        schema = DOC_SCHEMA
        if extra:  # names that clash with the operators' own
            rows = [(*r, 1, 2, "x", 4) for r in rows]
            schema += ", start long, hash long, line string, id long"
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
