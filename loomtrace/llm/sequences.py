"""Event sequences of the two trace tables, with events named by the smallest number of the same event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions.events import same_events
from loomtrace.functions.packed import event_numbers, event_values
from loomtrace.operators.unpack import typed_traces
from loomtrace.sources.tables import table


def block_key(block: Column) -> Column:
    """A block id without letter case and surrounding blanks; null for a blank one."""
    return F.nullif(F.lower(F.btrim(block, F.lit(" \t\r\n"))), F.lit(""))


def both_sources(spark: SparkSession, folder: str) -> DataFrame:
    """``src``, ``row_id``, ``block`` (see `block_key`), ``events`` ARRAY<INT>, ``gaps`` ARRAY<DOUBLE>: rows of
    event_traces, whose events are null where the row is not valid, and of block_sequences, which have no gaps."""
    names = same_events(table(spark, folder, "hdfs_log_templates"))
    valid = F.size("_reasons") == 0
    traces = typed_traces(table(spark, folder, "event_traces"), names=names).select(
        F.lit("event_traces").alias("src"), "row_id", block_key(F.col("BlockId")).alias("block"), F.when(valid, F.col("_events")).alias("events"), F.when(valid, F.col("_gaps")).alias("gaps")
    )
    blocks = table(spark, folder, "block_sequences").withColumn("_values", event_values(F.col("event_ids"))).select(
        F.lit("block_sequences").alias("src"),
        "row_id",
        block_key(F.col("block_id")).alias("block"),
        event_numbers(F.col("_values"), names).alias("events"),
        F.lit(None).cast("array<double>").alias("gaps"),
    )
    return traces.unionByName(blocks)
