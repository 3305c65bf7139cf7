import pytest


@pytest.fixture
def documents(spark):
    """Frame of documents from (doc_id, text) pairs."""
    def make(*pairs, extra=False):
        rows = [(i, t, "en", "s", len(t or "")) for i, t in pairs]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        return df.selectExpr("*", "'x' AS fp", "1 AS leaf", "0 AS n_words", "'y' AS component_id") if extra else df
    return make
