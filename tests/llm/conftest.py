import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, lang]) with columns whose names clash with the operators' own."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in ("ids", "digest", "keep_id", "n", "a", "b", "gram", "id", "component", "start", "length", "key"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
        return df
    return make


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
