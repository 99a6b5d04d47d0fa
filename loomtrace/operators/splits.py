"""Train, validation and test splits of traces, and what they share."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions.sequences import hash_part, template_text
from loomtrace.operators.allocation import allocate
from loomtrace.session import shared_checkpoint

SPLITS = ("train", "validation", "test")


def seeded(seed: int, *keys: str) -> Column:
    """A key that orders rows at random, the same for the same seed."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *keys).cast("binary"))


def stratified_split(df: DataFrame, seed: int = 42, validation: float = 0.15, test: float = 0.15) -> DataFrame:
    """Each label's blocks in seeded order: the first share validates, the next tests, the rest trains.

    A block's place comes from counts of hash ranges of its label and its rank within its range, so that no window
    holds a whole label."""
    keyed = df.withColumn("_key", seeded(seed, "block_id")).withColumn("_range", F.left("_key", F.lit(3)))
    ranges = keyed.groupBy("label", "_range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("label").orderBy("_range")) - F.col("n")  # at most 4096 rows a label
    sizes = ranges.withColumns({"before": before, "total": F.sum("n").over(Window.partitionBy("label"))}).select("label", "_range", "before", "total")
    rank = F.row_number().over(Window.partitionBy("label", "_range").orderBy("_key", "block_id")) - 1
    placed = keyed.withColumn("_rank", rank).join(F.broadcast(sizes), ["label", "_range"]).withColumn("_at", F.col("before") + F.col("_rank"))
    nv, nt = F.floor(F.col("total") * F.lit(validation)), F.floor(F.col("total") * F.lit(test))
    split = F.when(F.col("_at") < nv, "validation").when(F.col("_at") < nv + nt, "test").otherwise("train")
    return placed.withColumn("split", split).drop("_key", "_range", "_rank", "_at", "before", "total")


def hash_split(df: DataFrame, key: str = "sig", train: int = 70, validation: int = 15) -> DataFrame:
    """All rows of one key in one split, by a hash of the key; no shuffle."""
    part = hash_part(F.col(key))
    return df.withColumn("split", F.when(part < train, "train").when(part < train + validation, "validation").otherwise("test"))


def greedy_split(df: DataFrame, seed: int = 42, validation: float = 0.15, test: float = 0.15, key: str = "sig") -> DataFrame:
    """Groups stay whole; sizes and anomalies of the splits come near their shares.

    Every group takes part: the driver gets the classes of equal blocks and anomalies with their counts, which
    `allocate` distributes, and a group's split comes from its seeded rank in its class, by counts of hash ranges as in
    `stratified_split`. Every split has blocks of both labels where there are enough groups."""
    size = ["_blocks", "_anomalies"]
    counted = df.groupBy(key).agg(F.count("*").alias("_blocks"), F.count_if(F.col("label") == "Anomaly").alias("_anomalies"))
    groups = counted.withColumn("_key", seeded(seed, key)).withColumn("_range", F.left("_key", F.lit(3)))
    table = groups.groupBy(*size).agg(F.count("*").alias("n")).toPandas().sort_values(size).reset_index(drop=True)
    blocks, anomalies, members = (table[c].to_numpy(np.int64) for c in (*size, "n"))
    ends = allocate(np.c_[blocks - anomalies, anomalies], members, (1 - validation - test, validation, test)).cumsum(1)
    rows = [(int(b), int(a), int(e[0]), int(e[1])) for b, a, e in zip(blocks, anomalies, ends)]
    cuts = df.sparkSession.createDataFrame(rows, "_blocks long, _anomalies long, _train long, _validation long")
    ranges = groups.groupBy(*size, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*size).orderBy("_range")) - F.col("_n")  # at most 4096 rows a class
    starts = ranges.withColumn("_before", before).drop("_n")
    rank = F.row_number().over(Window.partitionBy(*size, "_range").orderBy("_key", key)) - 1
    placed = groups.withColumn("_rank", rank).join(starts, [*size, "_range"]).join(cuts, size).withColumn("_at", F.col("_before") + F.col("_rank"))
    split = F.when(F.col("_at") < F.col("_train"), "train").when(F.col("_at") < F.col("_validation"), "validation").otherwise("test")
    assigned = placed.select(F.col(key).alias("_group"), split.alias("split"))
    return df.join(assigned, F.col(key).eqNullSafe(F.col("_group"))).drop("_group")


def composition(df: DataFrame) -> DataFrame:
    """Blocks, blocks of each label, prevalence and share of all blocks of every split."""
    counted = df.groupBy("split").agg(F.count("*").alias("blocks"), F.count_if(F.col("label") == "Normal").alias("normal"), F.count_if(F.col("label") == "Anomaly").alias("anomaly"))
    share = F.col("blocks") / F.sum("blocks").over(Window.partitionBy(F.lit(1)))  # three rows
    return counted.withColumns({"anomaly_prevalence": F.col("anomaly") / F.col("blocks"), "fraction_of_all": share})


def pairwise_overlap(df: DataFrame, key: str = "sig") -> DataFrame:
    """How many keys two splits share, for each pair of splits, from one aggregation by key."""
    held = df.groupBy(key).agg(F.array_distinct(F.sort_array(F.collect_set("split"))).alias("s"))  # at most three values
    pairs = [(a, b) for i, a in enumerate(SPLITS) for b in SPLITS[i + 1 :]]
    counts = held.agg(*(F.count_if(F.array_contains("s", a) & F.array_contains("s", b)).alias(f"{a}_{b}") for a, b in pairs))
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("shared")) for a, b in pairs)))
    return counts.select(each.alias("x")).select("x.*")


def normal_knowledge(df: DataFrame, key: str = "sig") -> DataFrame:
    """Normal training sequences, once each, with count and smallest block."""
    train = df.where((F.col("split") == "train") & (F.col("label") == "Normal"))
    return train.groupBy(key).agg(F.count("*").alias("occurrence_count"), F.min("block_id").alias("representative_block_id"), F.any_value("event_ids").alias("event_ids"))


def with_template_text(df: DataFrame, templates: dict[str, str]) -> DataFrame:
    return df.withColumn("template_text", template_text(F.col("event_ids"), templates))


def ordered_index(df: DataFrame, by: str, order: Sequence[Column], out: str) -> DataFrame:
    """Number the rows of each ``by`` from 0 in a total order, without one task per class.

    Rows are range-partitioned and sorted once; a row's number is its place in its partition and the rows of its class
    in the partitions before, of which there is one count each. ``order`` must leave no ties for a stable result."""
    ranged = df.repartitionByRange(F.col(by), *order).sortWithinPartitions(F.col(by), *order)
    # cut here: ranges are drawn from a sample, so that a second evaluation could cut elsewhere
    placed = shared_checkpoint(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    first = placed.groupBy("_part", by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_part")) - F.col("_n")  # one row per partition and class
    starts = first.select("_part", by, "_first", before.alias("_before"))
    numbered = placed.join(starts, ["_part", by])
    return numbered.withColumn(out, (F.col("_at") - F.col("_first") + F.col("_before")).cast("int")).drop("_at", "_part", "_first", "_before")


def knowledge_variants(df: DataFrame) -> DataFrame:
    """Normal, anomaly and mixed knowledge bases of the training part, each in a fixed order: by sequence, and normal
    before anomaly in the mixed one. The index counts from 0 within a variant."""
    train = df.where(F.col("split") == "train")
    both = train.groupBy("event_ids").agg((F.count_distinct("label") > 1).alias("conflicting_sequence"))
    each = train.groupBy("event_ids", "label").agg(F.count("*").alias("occurrence_count"), F.min("block_id").alias("representative_block_id"))
    rows = each.join(both, "event_ids").withColumn("variant", F.explode(F.array(F.lower("label"), F.lit("mixed"))))
    return ordered_index(rows, "variant", (F.desc("label"), F.col("event_ids")), "kb_index")


def seen_flags(df: DataFrame, key: str = "sig") -> DataFrame:
    """For rows outside training: whether their sequence occurs in training, is in the Normal knowledge base, and has
    both labels anywhere. One aggregation by key and one join back."""
    facts = df.groupBy(key).agg(
        F.bool_or(F.col("split") == "train").alias("seen_in_train"),
        F.bool_or((F.col("split") == "train") & (F.col("label") == "Normal")).alias("exact_match_in_normal_kb"),
        (F.count_distinct("label") > 1).alias("conflicting_trace"),
    )
    return df.where(F.col("split") != "train").join(facts, key)


def seen_report(df: DataFrame, key: str = "sig") -> DataFrame:
    """Seen and unseen rows by split and label, with rates."""
    counted = seen_flags(df, key).groupBy("split", "label").agg(F.count("*").alias("blocks"), F.count_if("seen_in_train").alias("seen"), F.count_if("exact_match_in_normal_kb").alias("exact"))
    return counted.withColumns({"seen_rate": F.col("seen") / F.col("blocks"), "exact_rate": F.col("exact") / F.col("blocks")})


def knowledge_compression(df: DataFrame, key: str = "sig") -> DataFrame:
    train = df.where((F.col("split") == "train") & (F.col("label") == "Normal"))
    return train.agg(F.count("*").alias("blocks"), F.count_distinct(key).alias("entries")).withColumn("ratio", F.try_divide(F.col("entries").cast("double"), F.col("blocks")))


def sample_uniform(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in seeded order, as a top-n; all rows where there are fewer."""
    return df.orderBy(seeded(seed, "block_id"), "block_id").limit(n)


def sample_stratified(df: DataFrame, counts: dict[str, int], seed: int = 42) -> DataFrame:
    """The given number of rows of each label."""
    parts = [sample_uniform(df.where(F.col("label") == label), n, seed) for label, n in counts.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def split_violations(df: DataFrame, key: str | None = "sig") -> DataFrame:
    """Rows that break what a split promises: unique blocks, all assigned, both labels in each, groups whole."""
    blocks = df.groupBy("block_id").agg(F.count("*").alias("n")).agg(F.lit("repeated_blocks").alias("check"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
    unassigned = df.agg(F.lit("unassigned_rows").alias("check"), F.count_if(F.col("split").isNull() | ~F.col("split").isin(*SPLITS)).alias("violations"))
    both = df.groupBy("split").agg(F.count_distinct("label").alias("n")).agg(F.lit("splits_without_both_labels").alias("check"), F.count_if(F.col("n") < 2).alias("violations"))
    out = blocks.unionByName(unassigned).unionByName(both)
    if key:
        crossing = df.groupBy(key).agg(F.count_distinct("split").alias("n")).agg(F.lit("groups_across_splits").alias("check"), F.count_if(F.col("n") > 1).alias("violations"))
        out = out.unionByName(crossing)
    return out
