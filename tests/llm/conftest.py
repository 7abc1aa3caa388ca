import pytest


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    """Texts of the smallest documents table with odd cases: null, empty, blank, repeated, long."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    odd = [None, "", " \t\n", "a", "x" * 5000, "don't  we'll\r\n　 été !! 12½ \U0001f600", "one two three one two three"]
    return rows + [(1000 + i, t) for i, t in enumerate(odd)] + rows[:3]


@pytest.fixture(scope="session")
def frame(spark, documents):
    """The same as a table with further columns whose names operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents, "doc_id long, text string").repartition(4)
    return df.withColumns({c: F.lit(1) for c in ("k", "t", "n", "rank", "length", "row", "kept", "score", "key", "fp")})
