"""Queries on packed fields and unreadable rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.operators.unpack import accepted, packed_values, rejected, typed_lines, typed_traces
from loomtrace.plans import packing_sql
from loomtrace.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the lists that are not plain, in valid rows of event_traces."""
    return packed_values(typed_traces(table(spark, sf_dir, "event_traces")), ["row_id"], only_packed=True)


def p3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of both fields of every valid row of event_traces."""
    return packed_values(typed_traces(table(spark, sf_dir, "event_traces")), ["row_id"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of event_traces and lines of raw_trace_lines that cannot be loaded, with the reason."""
    traces = rejected(typed_traces(table(spark, sf_dir, "event_traces"))).select(F.lit("event_traces").alias("src"), "row_id", "reason")
    lines = rejected(typed_lines(table(spark, sf_dir, "raw_trace_lines"))).select(
        F.lit("raw_trace_lines").alias("src"), F.col("line_id").alias("row_id"), "reason"
    )
    return traces.unionByName(lines)


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows and lines that can be loaded, as typed traces; their lists as texts of plain ids and of gaps with three
    decimals."""
    three = lambda x: F.coalesce(x.try_cast("decimal(38,3)").cast("string"), F.format_string("%.3f", x.try_cast("double")))

    def typed(df: DataFrame, src: str, key: str) -> DataFrame:
        ids = F.array_join(F.transform("_events", lambda n: F.concat(F.lit("E"), n.cast("string"))), " ")
        gaps = F.when(F.col("_gap_values") == "", "").otherwise(F.array_join(F.transform(F.split("_gap_values", ","), three), " "))
        return accepted(df).select(F.lit(src).alias("src"), F.col(key).alias("row_id"), "BlockId", "Label", "Type", ids.alias("events"), gaps.alias("gaps"), F.col("_latency").alias("latency"))

    return typed(typed_traces(table(spark, sf_dir, "event_traces")), "event_traces", "row_id").unionByName(
        typed(typed_lines(table(spark, sf_dir, "raw_trace_lines")), "raw_trace_lines", "line_id")
    )


QUERIES = {"p3_found": p3_found, "p3_values": p3_values, "p5_found": p5_found, "p5_loaded": p5_loaded}
ORACLES = {"p3_found": packing_sql.P3_FOUND, "p3_values": packing_sql.P3_VALUES, "p5_found": packing_sql.P5_FOUND, "p5_loaded": packing_sql.P5_LOADED}
