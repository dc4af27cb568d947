import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Frame of documents from (doc_id, text) pairs, with columns whose names clash with results."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "src", 0 if t is None else len(t), 1, "x", 2.0) for i, t in rows],
            "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, hits string, score double")
    return make
