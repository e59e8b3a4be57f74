import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds a documents table from (doc_id, text, source) rows."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)

    return build


@pytest.fixture
def saved(tmp_path, docs):
    """Writes a documents table and returns the folder that queries read."""

    def build(rows):
        docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return build
