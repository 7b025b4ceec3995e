import pytest


@pytest.fixture
def documents(spark):
    """A documents table of (doc_id, text) pairs, with columns whose names clash with results."""

    def make(rows):
        rows = [(i, t, "en", "s", None if t is None else len(t), "x", 1) for i, t in rows]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, node int"
        )

    return make
