"""Block traces from a stream of events, by session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_traces(events: DataFrame, entity: str = "user_id", at: str = "ts", event: str = "event_type", gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Traces of an event table or stream: an entity's events with no pause longer than ``gap`` make one block.

    Works on batch and streaming frames alike; on a stream, events later than ``late`` are left out and a block comes
    out once the watermark has passed its end. Rows with null time or entity are left out. A block's size is bounded by
    its session, not by the entity's history."""
    timed = events.where(F.col(at).isNotNull() & F.col(entity).isNotNull()).withColumn(at, F.col(at).cast("timestamp"))
    marked = timed.withWatermark(at, late) if events.isStreaming else timed
    grouped = marked.groupBy(F.col(entity).alias("entity"), F.session_window(at, gap).alias("w")).agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), F.col(event).alias("event")))).alias("e"))
    micros = lambda x: F.unix_micros(x["at"])
    gaps = F.when(
        F.size("e") > 1, F.transform(F.sequence(F.lit(1), F.size("e") - 1), lambda i: (micros(F.get("e", i)) - micros(F.get("e", i - 1))) / 1e6)
    ).otherwise(F.array().cast("array<double>"))
    return grouped.select(
        F.concat_ws("_", F.col("entity").cast("string"), F.date_format("w.start", "yyyyMMddHHmmss")).alias("block_id"),
        F.transform("e", lambda x: x["event"]).alias("event_ids"),
        gaps.alias("gaps"),
        ((micros(F.element_at("e", -1)) - micros(F.get("e", F.lit(0)))) / 1e6).alias("latency"),
    )
