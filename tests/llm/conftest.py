import pytest

from pyspark.sql import functions as F

EXTRA = {"size": "x", "taken": 1, "row": "r", "id": 2, "fp": 3, "t1": "t", "lines": 4}


@pytest.fixture
def docs(spark):
    """documents-like tables from (doc_id, text[, lang, source]) rows, with clashing extra columns if asked for."""

    def make(rows, extra=False):
        full = [(*r, *("en", "s")[len(r) - 2 :]) if len(r) < 4 else r for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
        df = df.withColumn("n_chars", F.length("text").cast("long"))
        for name, value in EXTRA.items() if extra else ():
            df = df.withColumn(name, F.lit(value))
        return df

    return make


@pytest.fixture(scope="session")
def sample():
    import os

    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("the driver's tables aren't here")
    return pq.read_table(path).to_pylist()
