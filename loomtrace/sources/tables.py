"""Tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table, scanned with the columns and filters that the plan above it needs."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
