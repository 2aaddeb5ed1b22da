import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """texts, or (id, text) pairs -> a table like documents, with extra columns whose names clash with the operators' own."""

    def make(rows, partitions=3):
        rows = [(i, r) if not isinstance(r, tuple) else r for i, r in enumerate(rows)]
        frame = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
        for name in ("digest", "n", "class", "hits", "score", "token", "kept", "row", "words"):
            frame = frame.selectExpr("*", f"'x' AS {name}")
        return frame.repartition(partitions)

    return make
