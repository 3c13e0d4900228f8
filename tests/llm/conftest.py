import pytest


@pytest.fixture
def clashing(spark):
    """Rows of documents with extra columns whose names clash with what operators add."""

    def make(rows, schema="doc_id long, text string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, schema)
        return df.select("*", *[F.lit("mine").alias(c) for c in ("shard", "slot", "kept", "fp", "failures", "length", "key", "host", "rank", "v")])

    return make
