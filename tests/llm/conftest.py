import pytest
from samples import DATA, odd_rows


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with extra columns whose names clash with results."""
    rows = [(i, t, None, "src", 1.5, "k", True) for i, t in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, label string, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def sample_texts(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}
