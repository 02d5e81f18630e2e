import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """documents([(doc_id, text), ...]) with columns whose names clash with those that operators make"""
    def make(rows, source="src0", lang="en"):
        schema = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, n long, key string, bucket int, copies int, component_id long"
        return spark.createDataFrame([(i, t, lang, source, 0, 0.5, 1, 2, "k", 3, 4, 5) for i, t in rows], schema)

    return make
