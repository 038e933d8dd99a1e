"""Tables of a folder of Parquet files or folders, and delimited text with its delimiter found from the header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def delimited(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Text with a header row; the delimiter is the most frequent of , | ; and tab in it."""
    header = spark.read.text(path).first()
    line = header[0] if header else ""
    mark = max(",|;\t", key=lambda c: (line.count(c), -",|;\t".index(c)))
    reader = spark.read.option("header", True).option("sep", mark)
    return (reader.schema(schema) if schema else reader).csv(path)


def integers(spark: SparkSession, n: int, trial: int = 0) -> DataFrame:
    """v: the n integers of a trial, [trial n, (trial + 1) n)."""
    return spark.range(trial * n, (trial + 1) * n).withColumnRenamed("id", "v")
