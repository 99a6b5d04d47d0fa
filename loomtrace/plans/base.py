"""The traces that the profile, split and retrieval queries work on, and the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions.sequences import BLANKS, bracket_list, number_list, trace_signature
from loomtrace.operators.unpack import accepted, typed_traces
from loomtrace.plans.packing_sql import TRACES as JUDGED
from loomtrace.session import shared_checkpoint
from loomtrace.sources.tables import table

TRIM = r"' ' || chr(9) || chr(13) || chr(10)"

#: SQL of the source rows with cleaned keys and labels and parsed lists.
RAW_SQL = f"""
raw0 AS (
  SELECT row_id, nullif(lower(trim(BlockId, {TRIM})), '') AS block_id,
         CASE lower(trim(Label, {TRIM})) WHEN 'success' THEN 'Normal' WHEN 'fail' THEN 'Anomaly' END AS label,
         Type AS type, Features AS features, TimeInterval AS intervals, Latency AS latency, node_id, started_at,
         CASE WHEN starts_with(Features, '[') AND ends_with(Features, ']') AND length(Features) >= 2 THEN Features[2:length(Features)-1] END AS body,
         CASE WHEN starts_with(TimeInterval, '[') AND ends_with(TimeInterval, ']') AND length(TimeInterval) >= 2 THEN TimeInterval[2:length(TimeInterval)-1] END AS gbody
  FROM event_traces),
raw1 AS (
  SELECT *, CASE WHEN trim(body, {TRIM}) = '' THEN []::VARCHAR[] ELSE list_transform(string_split(body, ','), lambda x: trim(x, {TRIM})) END AS items,
            CASE WHEN trim(gbody, {TRIM}) = '' THEN []::VARCHAR[] ELSE list_transform(string_split(gbody, ','), lambda x: trim(x, {TRIM})) END AS gitems
  FROM raw0),
raw AS (
  SELECT row_id, block_id, label, type, features, intervals, latency, node_id, started_at,
         CASE WHEN NOT list_contains(items, '') THEN items END AS event_ids,
         CASE WHEN NOT list_contains(gitems, '') THEN list_transform(gitems, lambda x: try_cast(x AS DOUBLE)) END AS gaps
  FROM raw1)"""

#: SQL of one trace per block: its first valid row that has a label.
TRACES_SQL = (
    f"""valid AS (
  WITH {JUDGED}
  SELECT row_id, nullif(lower(trim(BlockId, {TRIM})), '') AS block_id, CASE lower(trim(Label, {TRIM})) WHEN 'success' THEN 'Normal' WHEN 'fail' THEN 'Anomaly' END AS label, Type AS type, Latency AS latency,
         list_transform(events, lambda x: 'E' || x) AS event_ids, list_transform(gap_texts, lambda x: x::DOUBLE) AS gaps
  FROM judged JOIN event_traces USING (row_id) WHERE fault IS NULL)"""
    + """,
traces AS (
  SELECT block_id, t.* FROM (
    SELECT block_id, arg_min(struct_pack(row_id := row_id, event_ids := event_ids, label := label, type := type, gaps := gaps, latency := latency), row_id) AS t
    FROM valid WHERE block_id IS NOT NULL AND label IS NOT NULL GROUP BY block_id)),
signed AS (SELECT *, sha256(to_json(event_ids)::VARCHAR) AS sig FROM traces),
splits AS (
  SELECT *, CASE WHEN p < 70 THEN 'train' WHEN p < 85 THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, ('0x' || substr(md5(sig), 1, 15))::BIGINT % 100 AS p FROM signed))"""
)


def block_key(block: Column) -> Column:
    """A block id without letter case and surrounding blanks; null for a blank one."""
    return F.nullif(F.lower(F.btrim(block, F.lit(BLANKS))), F.lit(""))


def clean_label(label: Column) -> Column:
    """Normal or Anomaly of the source's Success and Fail; null for anything else."""
    word = F.lower(F.btrim(label, F.lit(BLANKS)))
    return F.when(word == "success", "Normal").when(word == "fail", "Anomaly")


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of event_traces with clean keys and labels and parsed lists, which are null where malformed."""
    return table(spark, sf_dir, "event_traces").select(
        "row_id",
        block_key(F.col("BlockId")).alias("block_id"),
        clean_label(F.col("Label")).alias("label"),
        F.col("Type").alias("type"),
        F.col("Features").alias("features"),
        F.col("TimeInterval").alias("intervals"),
        F.col("Latency").alias("latency"),
        "node_id",
        "started_at",
        bracket_list(F.col("Features")).alias("event_ids"),
        number_list(F.col("TimeInterval")).alias("gaps"),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace per block: ``block_id``, ``row_id``, ``event_ids``, ``label``, ``type``, ``gaps``, ``latency``.

    A block's trace is its first row, by row_id, that can be loaded (see `typed_traces`) and has a label. Rows are reduced
    to one per block before and after one shuffle by block."""
    usable = accepted(typed_traces(on_all_cores(table(spark, sf_dir, "event_traces")))).select(
        "row_id",
        block_key(F.col("BlockId")).alias("block_id"),
        clean_label(F.col("Label")).alias("label"),
        F.col("Type").alias("type"),
        F.col("Latency").alias("latency"),
        F.transform("_events", lambda n: F.concat(F.lit("E"), n.cast("string"))).alias("event_ids"),
        F.col("_gaps").alias("gaps"),
    )
    first = F.min_by(F.struct("row_id", "event_ids", "label", "type", "gaps", "latency"), "row_id")
    return usable.where("block_id IS NOT NULL AND label IS NOT NULL").groupBy("block_id").agg(first.alias("t")).select("block_id", "t.*")


def held_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`traces`, read once for queries that use them several times."""
    return shared_checkpoint(traces(spark, sf_dir))


def on_all_cores(df: DataFrame) -> DataFrame:
    """The rows of a scan that has fewer parts than the session has cores, spread over all cores; any other as it is, so
    that nothing is shuffled where files are many or large."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def signed(df: DataFrame) -> DataFrame:
    return df.withColumn("sig", trace_signature(F.col("event_ids")))


def templates(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The event dictionary, a fixed table of 29 rows."""
    return {r["EventId"]: r["EventTemplate"] for r in table(spark, sf_dir, "hdfs_log_templates").collect()}
