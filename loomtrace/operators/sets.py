"""Set relations of keys between tables, as joins; no key set reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keys(df: DataFrame, key: str, alias: str = "key") -> DataFrame:
    """The distinct keys that are not null."""
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias(alias)).distinct()


def overlap(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """Sizes of two key sets, their union, intersection and differences, and whether they are equal or one holds the
    other, from one pass over each: keys are tagged, united and grouped."""
    tagged = keys(a, key).select("key", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(keys(b, key).select("key", F.lit(0).alias("a"), F.lit(1).alias("b")))
    held = tagged.groupBy("key").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    counted = held.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("in_a"), F.coalesce(F.sum("b"), F.lit(0)).alias("in_b"), F.count("*").alias("either"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"),
        F.count_if(F.col("b") == 0).alias("only_a"), F.count_if(F.col("a") == 0).alias("only_b"),
    )
    return counted.withColumns({"equal": (F.col("only_a") + F.col("only_b")) == 0, "a_in_b": F.col("only_a") == 0, "b_in_a": F.col("only_b") == 0})


def present(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """Rows whose key the other table has."""
    return df.join(other.select(on), on, "left_semi")


def absent(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """Rows whose key the other table lacks; rows with a null key among them."""
    return df.join(other.select(on), on, "left_anti")


def with_presence(df: DataFrame, other: DataFrame, on: str, flag: str) -> DataFrame:
    """All rows, with a flag for those whose key the other table has."""
    found = keys(other, on, on).withColumn(flag, F.lit(True))
    return df.join(found, on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
