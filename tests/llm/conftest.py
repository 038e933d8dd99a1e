import pytest


@pytest.fixture
def docs(spark):
    """make(rows, schema=...) with an extra column whose name clashes with result columns."""

    def make(rows, extra=True):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        if not extra:
            return frame
        from pyspark.sql import functions as F

        for name in ("fingerprint", "score", "k_id", "h", "spans", "row", "label"):
            frame = frame.withColumn(name, F.lit("clash"))
        return frame.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src0").when(F.col("doc_id") % 3 == 1, "src1"))

    return make


ODD = [(None, "a null id"), (0, None), (1, ""), (2, "x"), (3, "x"), (3, "x"), (4, " \n\t "), (5, "long " * 30_000), (6, "ünïcödé 😀 text"), (7, "A" * 2000)]
