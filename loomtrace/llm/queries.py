"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.encode import encode
from loomtrace.llm.mixing import Mix, language_key, mix_sources, sized_documents
from loomtrace.llm.neighbours import measured_recall, nearest_vectors
from loomtrace.llm.patterns import frequent_patterns
from loomtrace.llm.runs import collapse_event_rows, collapse_runs
from loomtrace.llm.sequences import block_key, both_sources
from loomtrace.llm.sql import ORACLES
from loomtrace.llm.splits import grouped_splits, related_pairs, signature_key, split_report
from loomtrace.llm.truncation import truncated_texts, truncation_by_source
from loomtrace.session import shared_checkpoint
from loomtrace.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least two events."""
    runs = collapse_runs(both_sources(spark, sf_dir), "events", "gaps", at_least=2)
    return runs.select("src", "row_id", "first_pos", "last_pos")


def p1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run, single events too, with count and duration."""
    return collapse_runs(both_sources(spark, sf_dir).drop("block"), "events", "gaps").withColumn("duration", F.round("duration", 6))


def p1_event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the same kind of event of each user in the event table, which has one event per row."""
    runs = collapse_event_rows(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id")
    return runs.select(F.col("entity").alias("user_id"), F.col("first").alias("first_ts"), F.col("last").alias("last_ts"), F.col("event").alias("event_type"), "n_events")


def p2_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of three or four events that at least an eighth of the blocks hold, with the number of blocks."""
    return frequent_patterns(both_sources(spark, sf_dir).withColumnRenamed("block", "entity"), 1 / 8)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_patterns(spark, sf_dir).select("src", "pattern")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest row of each group of related records with each other row of the group."""
    return related_pairs(table(spark, sf_dir, "block_sequences"), "row_id", signature_key(F.col("trace_signature")), block_key(F.col("block_id")))


def _targets(spark: SparkSession, sf_dir: str) -> list[tuple[str, float]]:
    return [(r["split"], r["share"]) for r in table(spark, sf_dir, "split_targets").orderBy("split").collect()]  # a fixed table of three rows


def _anomalous() -> Column:
    """Whether a record is an anomaly; null where its label can't be read."""
    word = F.lower(F.trim("label"))
    return F.when(word == "anomaly", True).when(word == "normal", False)


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_splits(table(spark, sf_dir, "block_sequences"), "row_id", _anomalous(), _targets(spark, sf_dir), signature_key(F.col("trace_signature")), block_key(F.col("block_id")))


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every record of block_sequences."""
    return _assigned(spark, sf_dir).select("row_id", "split")


def p4_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the splits together and of each: records, groups, groups in several splits, whether the share is within 0.01 of
    its target and whether both labels are there."""
    labels = table(spark, sf_dir, "block_sequences").select("row_id", _anomalous().alias("anomalous"))
    report = split_report(_assigned(spark, sf_dir).join(labels, "row_id"), "anomalous", _targets(spark, sf_dir))
    return report.agg(
        F.count("*").alias("splits"), F.sum("records").alias("records"), F.sum("yes").alias("anomalies"), F.sum("no").alias("normals"), (F.sum("groups") - F.sum("crossing")).alias("whole_groups"),
        F.count_if(F.abs(F.col("share") - F.col("target")) <= 0.01).alias("near_target"), F.count_if((F.col("yes") > 0) & (F.col("no") > 0)).alias("with_both_labels"),
    )


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors of every usable vector."""
    return nearest_vectors(table(spark, sf_dir, "trace_vectors"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with cosine at least 0.9 of which one is among the five most similar of the other."""
    near = p6_neighbours(spark, sf_dir).where("cosine >= 0.9")
    return near.select(F.least("id", "neighbour").alias("vec_id_a"), F.greatest("id", "neighbour").alias("vec_id_b")).distinct()


def p6_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the five most similar vectors that p6_neighbours finds, for up to `TRIALS` vectors spread over the
    ids, which are compared with all others: ``trials``, ``neighbours`` and ``recall``."""
    return measured_recall(table(spark, sf_dir, "trace_vectors"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document's text."""
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, sf_dir: str, all_tokens: bool = False) -> Mix:
    documents = table(spark, sf_dir, "documents").withColumn("lang", language_key(F.col("lang")))
    sized = shared_checkpoint(sized_documents(documents, "doc_id", "text", ("source", "lang")))
    weights = [tuple(r) for r in table(spark, sf_dir, "mix_weights").select("source", "target_weight", "max_repeats").collect()]  # a fixed table of eight rows
    return mix_sources(sized, "doc_id", weights, float(sized.agg(F.sum("n_tokens")).first()[0] or 0) if all_tokens else None)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix with their copies and their source's target and actual share."""
    mixed, report, _ = _mix(spark, sf_dir)
    return mixed.join(F.broadcast(report.select("source", "target_share", "actual_share")), "source")  # one row for each source


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source of the mix."""
    return _mix(spark, sf_dir).report


def p8_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every language and topic of the mix."""
    return _mix(spark, sf_dir).marginals


def p8_report_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a mix that is to have as many tokens as there are, so that some sources fall short at their caps."""
    return _mix(spark, sf_dir, all_tokens=True).report


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut."""
    return truncated_texts(table(spark, sf_dir, "documents"), "doc_id", "text").where("cut").select("doc_id")


def p9_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts."""
    return truncation_by_source(truncated_texts(table(spark, sf_dir, "documents"), "doc_id", "text", ("source",)))


QUERIES = {"p1_found": p1_found, "p1_runs": p1_runs, "p1_event_runs": p1_event_runs, "p2_found": p2_found, "p2_patterns": p2_patterns, "p4_found": p4_found, "p4_splits": p4_splits, "p4_split_report": p4_split_report, "p6_found": p6_found, "p6_neighbours": p6_neighbours, "p6_recall": p6_recall, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_report": p8_report, "p8_marginals": p8_marginals, "p8_report_total": p8_report_total, "p9_found": p9_found, "p9_sources": p9_sources}

__all__ = ["ORACLES", "QUERIES"]
