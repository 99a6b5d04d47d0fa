"""Profiles of labelled traces. A trace frame has block_id, event_ids, label (Normal or Anomaly), type, gaps, latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions.sequences import knowledge_id, pairs, trace_signature
from loomtrace.session import shared_checkpoint

LABELS = ("Normal", "Anomaly")


def trace_features(df: DataFrame) -> DataFrame:
    """Length, distinct events, latency and gap sum of every trace."""
    return df.select(
        "block_id", "label", F.size("event_ids").alias("length"), F.size(F.array_distinct("event_ids")).alias("unique_events"), "latency",
        F.aggregate("gaps", F.lit(0.0), lambda total, x: total + x).alias("gap_sum"),
    )


def cumulative(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Each distinct value of each class with ``n``, the rows ``before`` and ``upto`` it in order, and the class's ``total``.

    Values are counted, sorted by range and summed within the parts, whose totals, one row for each part and class,
    complete the sums; so no class is gathered, however many distinct values it has. Nulls are left out."""
    rows = df.where(F.col(value).isNotNull()).select((F.col(by) if by else F.lit(0)).alias("_by"), F.col(value).alias("value"))
    counted = rows.groupBy("_by", "value").agg(F.count("*").alias("n"))
    # cut here: ranges are drawn from a sample, so that a second evaluation could cut elsewhere
    placed = shared_checkpoint(counted.repartitionByRange("_by", "value").withColumn("_part", F.spark_partition_id()))
    within = F.sum("n").over(Window.partitionBy("_by", "_part").orderBy("value"))
    parts = placed.groupBy("_by", "_part").agg(F.sum("n").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy("_by").orderBy("_part")) - F.col("_n")
    starts = parts.select("_by", "_part", ahead.alias("_ahead"), F.sum("_n").over(Window.partitionBy("_by")).alias("total"))
    joined = placed.withColumn("_within", within).join(starts, ["_by", "_part"]).withColumn("upto", F.col("_ahead") + F.col("_within"))
    return joined.select(*([F.col("_by").alias(by)] if by else []), "value", "n", (F.col("upto") - F.col("n")).alias("before"), "upto", "total")


def describe(df: DataFrame, value: str, by: str | None = None, percentiles: Sequence[float] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Count, mean, sample deviation, least, chosen linear percentiles and largest; nulls are left out. Percentiles are
    exact and come from `cumulative` counts, so that no buffer holds a class's values."""
    x = F.col(value).cast("double")
    grouped = df.groupBy(by) if by else df.groupBy()
    made = grouped.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    counts = cumulative(df.withColumn(value, x), value, by)
    names = {f"p{round(p * 100)}": (F.col("total") - 1) * F.lit(p) for p in percentiles}
    covers = lambda rank: F.max(F.when((F.col("before") <= rank) & (rank < F.col("upto")), F.col("value")))
    places = [(covers(F.floor(at)) + (F.max(at) - F.floor(F.max(at))) * (covers(F.ceil(at)) - covers(F.floor(at)))).alias(name) for name, at in names.items()]
    ranks = (counts.groupBy(by) if by else counts.groupBy()).agg(*places)
    joined = made.join(ranks, by, "left") if by else made.crossJoin(ranks)  # one row each
    return joined.select(*([by] if by else []), "n", "mean", "std", "min", *names, "max")


def counted_items(df: DataFrame, items: Column, *keep: str) -> DataFrame:
    """The distinct ``item`` of each row's array with its number ``k``, counted inside the row, so that nothing is shuffled."""
    held = df.select(*keep, items.alias("_items")).select(*keep, "_items", F.explode(F.array_distinct("_items")).alias("item"))
    return held.select(*keep, "item", F.size(F.filter("_items", lambda x: x == F.col("item"))).cast("long").alias("k"))


def occurrences(df: DataFrame) -> DataFrame:
    """Long form of the occurrence matrix: events of each block with their number; a block is one row."""
    return counted_items(df, F.col("event_ids"), "block_id").select("block_id", F.col("item").alias("event_id"), F.col("k").alias("n"))


def occurrence_matrix(df: DataFrame, events: Sequence[str]) -> DataFrame:
    """Wide form: a column for each event of the dictionary, 0 where it is missing. One pass, no shuffle."""
    count = lambda e: F.size(F.filter("event_ids", lambda x: x == e)).alias(e)
    return df.select("block_id", "label", "type", *(count(e) for e in events))


def event_statistics(df: DataFrame) -> DataFrame:
    """Per event: blocks that hold it and occurrences by label, prevalence by label and their difference."""
    sizes = df.agg(*(F.count_if(F.col("label") == x).alias(f"n_{x.lower()}") for x in LABELS))
    each = counted_items(df, F.col("event_ids"), "label").withColumnRenamed("item", "event_id").groupBy("event_id").agg(
        *(F.count_if(F.col("label") == x).alias(f"blocks_{x.lower()}") for x in LABELS),
        *(F.coalesce(F.sum(F.when(F.col("label") == x, F.col("k"))), F.lit(0)).alias(f"occurrences_{x.lower()}") for x in LABELS),
    )
    share = {x: F.try_divide(F.col(f"blocks_{x}").cast("double"), F.col(f"n_{x}")) for x in ("normal", "anomaly")}
    return each.join(F.broadcast(sizes)).select(  # one row of class sizes
        "event_id", "blocks_normal", "blocks_anomaly", "occurrences_normal", "occurrences_anomaly",
        share["normal"].alias("prevalence_normal"), share["anomaly"].alias("prevalence_anomaly"), (share["anomaly"] - share["normal"]).alias("prevalence_difference"),
    )


def transitions(df: DataFrame) -> DataFrame:
    """Neighbouring pairs by label: occurrences with their share of the label's pairs, and blocks that hold the pair
    with their share of the label's blocks."""
    sizes = df.groupBy("label").agg(F.count("*").alias("blocks_of_label"))
    # counted within a row first, so that a row sends each pair once
    held = df.select("label", pairs(F.col("event_ids")).alias("p")).select("label", F.explode(F.array_distinct("p")).alias("pair"), "p")
    each = held.select("label", "pair.a", "pair.b", F.size(F.filter("p", lambda x: x == F.col("pair"))).alias("k"))
    counted = each.groupBy("label", "a", "b").agg(F.sum("k").alias("n"), F.count("*").alias("blocks"))
    total = Window.partitionBy("label")  # at most one row per pair of events
    return counted.withColumn("share", F.col("n") / F.sum("n").over(total)).join(F.broadcast(sizes), "label").select(
        "label", F.col("a").alias("source"), F.col("b").alias("target"), "n", "share", "blocks", F.try_divide(F.col("blocks").cast("double"), F.col("blocks_of_label")).alias("prevalence")
    )


def sequence_groups(df: DataFrame) -> DataFrame:
    """One row per exact sequence: blocks of each label, smallest block, whether both labels occur."""
    counted = df.groupBy("event_ids").agg(F.count("*").alias("blocks"), *(F.count_if(F.col("label") == x).alias(x.lower()) for x in LABELS), F.min("block_id").alias("representative"))
    return counted.withColumns({"trace_signature": trace_signature(F.col("event_ids")), "conflicting": (F.col("normal") > 0) & (F.col("anomaly") > 0)})


def canonical_traces(df: DataFrame) -> DataFrame:
    """One row per sequence and label with its count, smallest block and knowledge id, and whether the sequence has
    several labels."""
    each = df.groupBy("event_ids", "label").agg(F.count("*").alias("occurrence_count"), F.min("block_id").alias("representative_block_id"))
    both = df.groupBy("event_ids").agg((F.count_distinct("label") > 1).alias("conflicting_sequence"))
    return each.join(both, "event_ids").withColumn("trace_id", knowledge_id(F.col("label"), F.col("event_ids")))


def duplicate_summary(df: DataFrame) -> DataFrame:
    """Totals over the groups of equal sequences, among them the least errors any sequence-only classifier makes."""
    return sequence_groups(df).agg(
        F.sum("blocks").alias("blocks"), F.count("*").alias("sequences"), F.count_if(F.col("blocks") > 1).alias("repeated_sequences"),
        F.coalesce(F.sum(F.when(F.col("blocks") > 1, F.col("blocks"))), F.lit(0)).alias("blocks_in_repeated"), (F.sum("blocks") - F.count("*")).alias("blocks_beyond_first"),
        F.count_if("conflicting").alias("conflicting_sequences"), F.coalesce(F.sum(F.when(F.col("conflicting"), F.col("blocks"))), F.lit(0)).alias("conflicting_blocks"),
        F.coalesce(F.sum(F.least("normal", "anomaly")), F.lit(0)).alias("least_errors"),
    )


def ambiguous_blocks(df: DataFrame) -> DataFrame:
    """The blocks whose sequence has both labels."""
    conflicts = sequence_groups(df).where("conflicting").select("event_ids", "trace_signature")
    return df.join(conflicts, "event_ids").select("block_id", "label", "trace_signature", F.size("event_ids").alias("length"))


def ecdf(df: DataFrame, value: str, by: str) -> DataFrame:
    """Empirical distribution function over the distinct values of each class, from `cumulative` counts."""
    return cumulative(df, value, by).select(by, "value", "n", (F.col("upto") / F.col("total")).alias("fraction"))


def value_shares(df: DataFrame, value: Column, by: str) -> DataFrame:
    """Counts of a value's occurrences in each class and their share of the class."""
    counted = df.groupBy(by, value.alias("value")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def group_size_histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    """Sizes of the groups of equal sequences in bins of equal ratio from 1 to one more than the largest."""
    sizes = df.groupBy("event_ids").agg(F.count("*").alias("blocks")).groupBy("blocks").agg(F.count("*").alias("groups"))
    largest = sizes.agg((F.log(F.max("blocks") + 1.0) / bins).alias("width"))
    place = F.least(F.lit(bins - 1), F.floor(F.log(F.col("blocks").cast("double")) / F.col("width") + 1e-9)).cast("int")
    return sizes.join(F.broadcast(largest)).groupBy(place.alias("bin")).agg(F.sum("groups").alias("groups"))  # one row


def missing_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and nulls of each column, from one pass."""
    counts = df.agg(F.count("*").alias("_rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns))).alias("x")
    return counts.select(each, "_rows").select("x.column", "x.missing", F.col("_rows").alias("rows"))


def type_tables(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The type's distribution by label (null kept), its missing values by label, and the rows in which its presence
    disagrees with the Anomaly label."""
    distribution = df.groupBy("label", "type").agg(F.count("*").alias("n"))
    missing = df.groupBy("label").agg(F.count("*").alias("rows"), F.count_if(F.col("type").isNull()).alias("missing"))
    leak = df.agg(F.count("*").alias("rows"), F.count_if(F.col("type").isNotNull() != (F.col("label") == "Anomaly")).alias("mismatches"))
    return distribution, missing, leak


def examples(df: DataFrame, n: int = 2) -> DataFrame:
    """The first ``n`` traces of each label by block; ranks are pruned before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("block_id")))
    return ranked.where(F.col("rank") <= n).select("label", "rank", "block_id", F.array_join("event_ids", " ").alias("events"))


def largest_differences(df: DataFrame, column: str, n: int = 12) -> DataFrame:
    """The ``n`` rows whose value is farthest from 0."""
    return df.orderBy(F.abs(F.round(column, 9)).desc(), "event_id").limit(n)
