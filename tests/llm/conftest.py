import pytest


@pytest.fixture()
def documents(spark):
    """Rows of (doc_id, text, lang, source, n_chars), with extra columns where wanted."""

    def make(rows, extra=""):
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + extra)

    return make
