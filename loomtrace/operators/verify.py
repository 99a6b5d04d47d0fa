"""Independent checks of prepared tables: everything is computed again from the traces and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.packed import event_numbers, event_values
from loomtrace.functions.sequences import BLANKS, template_text, trace_signature
from loomtrace.operators.quality import counters, missing_keys, repeated_keys, same_rows, union_checks
from loomtrace.operators.splits import SPLITS
from loomtrace.session import shared_checkpoint


def verify_sequences(prepared: DataFrame, source: DataFrame, templates: dict[str, str]) -> DataFrame:
    """``prepared``: block_id, trace_signature, event_ids, template_text, label, conflicting_trace. ``source``: block_id,
    event_ids, label. One row per check; all 0 for sound tables."""
    conflicts = source.groupBy("event_ids").agg((F.count_distinct("label") > 1).alias("_conflict"))
    again = prepared.join(source.select("block_id", F.col("event_ids").alias("_events"), F.col("label").alias("_label")), "block_id", "left").join(
        conflicts.withColumnRenamed("event_ids", "_events"), "_events", "left"
    )
    return union_checks(
        repeated_keys(prepared, "block_id", "prepared_repeated_blocks"),
        missing_keys(prepared, source, "block_id", "prepared_without_trace"),
        missing_keys(source, prepared, "block_id", "traces_not_prepared"),
        counters(
            again,
            label_differs=~F.col("label").eqNullSafe(F.col("_label")),
            events_differ=~F.col("event_ids").eqNullSafe(F.col("_events")),
            signature_differs=~F.col("trace_signature").eqNullSafe(trace_signature(F.col("event_ids"))),
            template_text_differs=~F.col("template_text").eqNullSafe(template_text(F.col("event_ids"), templates)),
            conflict_flag_differs=~F.col("conflicting_trace").eqNullSafe(F.col("_conflict")),
        ),
    )


def verify_manifest(manifest: DataFrame, prepared: DataFrame, grouped: bool) -> DataFrame:
    """A manifest (block_id, trace_signature, label, split) covers the prepared blocks once, agrees with them, has both
    labels in every split, and keeps signatures whole where ``grouped``."""
    same = manifest.select("block_id", "trace_signature", "label")
    both = manifest.groupBy("split").agg(F.count_distinct("label").alias("n")).agg(
        F.lit("splits_without_both_labels").alias("check"), (F.count_if(F.col("n") < 2) + len(SPLITS) - F.count_if(F.col("split").isin(*SPLITS))).alias("violations")
    )
    parts = [repeated_keys(manifest, "block_id", "manifest_repeated_blocks"), same_rows(same, prepared.select("block_id", "trace_signature", "label"), "manifest_rows_differ"), both]
    if grouped:
        crossing = manifest.groupBy("trace_signature").agg(F.count_distinct("split").alias("n"))
        parts.append(crossing.agg(F.lit("signatures_across_splits").alias("check"), F.count_if(F.col("n") > 1).alias("violations")))
    return union_checks(*parts)


def verify_knowledge(knowledge: DataFrame, manifest: DataFrame) -> DataFrame:
    """A Normal knowledge base (trace_id = signature, occurrence_count, representative_block_id) is that of the
    manifest's Normal training blocks."""
    train = manifest.where((F.col("split") == "train") & (F.col("label") == "Normal"))
    wanted = train.groupBy(F.col("trace_signature").alias("trace_id")).agg(F.count("*").alias("occurrence_count"), F.min("block_id").alias("representative_block_id"))
    members = knowledge.join(train.select(F.col("block_id").alias("representative_block_id")), "representative_block_id", "left_anti")
    return union_checks(
        repeated_keys(knowledge, "trace_id", "knowledge_repeated_ids"),
        same_rows(knowledge.select("trace_id", "occurrence_count"), wanted.select("trace_id", "occurrence_count"), "knowledge_counts_differ"),
        same_rows(knowledge.select("trace_id", "representative_block_id"), wanted.select("trace_id", "representative_block_id"), "knowledge_representatives_differ"),
        members.agg(F.lit("representatives_outside_normal_train").alias("check"), F.count("*").alias("violations")),
    )


def verify_annotations(annotations: DataFrame, manifest: DataFrame) -> DataFrame:
    """The three flags of every row outside training, computed again."""
    facts = manifest.groupBy("trace_signature").agg(
        F.bool_or(F.col("split") == "train").alias("_seen"),
        F.bool_or((F.col("split") == "train") & (F.col("label") == "Normal")).alias("_exact"),
        (F.count_distinct("label") > 1).alias("_conflict"),
    )
    rows = manifest.where(F.col("split") != "train")
    return union_checks(
        missing_keys(rows, annotations, "block_id", "annotations_missing"),
        missing_keys(annotations, rows, "block_id", "annotations_beyond_manifest"),
        counters(
            annotations.join(facts, "trace_signature", "left"),
            seen_flag_differs=~F.col("seen_in_train").eqNullSafe(F.col("_seen")),
            exact_flag_differs=~F.col("exact_match_in_normal_kb").eqNullSafe(F.col("_exact")),
            conflict_annotation_differs=~F.col("conflicting_trace").eqNullSafe(F.col("_conflict")),
        ),
    )


def _plain_events(text: Column) -> Column:
    """Plainly spelled ids of a packed list; null where it can't be read or holds something else."""
    numbers = event_numbers(event_values(text))
    return F.when((F.size(numbers) > 0) & ~F.exists(numbers, lambda n: n.isNull()), F.transform(numbers, lambda n: F.concat(F.lit("E"), n.cast("string"))))


def verify_delivered(blocks: DataFrame, knowledge: DataFrame, labels: DataFrame) -> DataFrame:
    """Checks of delivered tables, which may be dirty: ``blocks`` (block_id, trace_signature, event_ids, sequence_length,
    label, conflicting_trace), ``knowledge`` (trace_id, event_ids, template_text) and ``labels`` (block_id, truth; one row
    per block). One row per check with the number of rows that break it. What is missing or can't be read is counted as
    such and breaks no other check; a conflict is one between readable labels of rows with the same events."""
    word = F.lower(F.btrim("label", F.lit(BLANKS)))
    read = blocks.select(
        F.nullif(F.lower(F.btrim("block_id", F.lit(BLANKS))), F.lit("")).alias("block_id"),
        F.nullif(F.regexp_extract(F.lower("trace_signature"), "([0-9a-f]{64})", 1), F.lit("")).alias("sig"),
        F.when(F.spark_partition_id() >= 0, _plain_events(F.col("event_ids"))).alias("events"),  # evaluated once
        F.col("event_ids").isNotNull().alias("listed"), "sequence_length", F.col("conflicting_trace").alias("flag"),
        F.when(word == "normal", "Normal").when(word == "anomaly", "Anomaly").alias("label"),
    )
    own = shared_checkpoint(read.withColumn("again", trace_signature(F.col("events"))))
    conflicts = own.where("again IS NOT NULL").groupBy("again").agg((F.count_distinct("label") > 1).alias("both"))
    joined = own.join(labels, "block_id", "left").join(conflicts, "again", "left")
    kept = shared_checkpoint(knowledge.select("trace_id", F.when(F.spark_partition_id() >= 0, trace_signature(_plain_events(F.col("event_ids")))).alias("again"), F.col("template_text").isNull().alias("bare")))
    lacking = kept.select(F.col("trace_id").alias("sig")).join(own.select("sig"), "sig", "left_anti")
    return union_checks(
        counters(
            joined,
            block_ids_missing=F.col("block_id").isNull(),
            signatures_missing=F.col("sig").isNull(),
            events_unreadable=F.col("listed") & F.col("events").isNull(),
            events_missing=~F.col("listed"),
            signature_differs=F.col("sig") != F.col("again"),
            length_differs=F.col("sequence_length") != F.when(F.col("events").isNotNull(), F.size("events")),
            labels_unknown=F.col("label").isNull(),
            label_differs=F.col("label") != F.col("truth"),
            conflict_flag_differs=F.col("flag") != F.col("both"),
        ),
        repeated_keys(own, "block_id", "block_ids_repeated"),
        repeated_keys(kept, "trace_id", "knowledge_ids_repeated"),
        counters(kept, knowledge_id_differs=F.col("trace_id") != F.col("again"), knowledge_texts_missing=F.col("bare")),
        lacking.agg(F.lit("knowledge_without_block").alias("check"), F.count("*").alias("violations")),
    )
