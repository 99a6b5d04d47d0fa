"""Integrity counters over source tables and checks of prepared tables; every check gives a row, also at 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("Normal", "Anomaly")


def counters(df: DataFrame, **violations: Column) -> DataFrame:
    """``check``, ``violations`` of one pass over ``df``: rows for which a condition holds, or sums of a number. Null
    counts as no violation."""
    sums = df.agg(*(F.coalesce(F.sum(v.cast("long")), F.lit(0)).alias(name) for name, v in violations.items()))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("check"), F.col(name).alias("violations")) for name in violations)))
    return sums.select(each.alias("x")).select("x.*")


def missing_keys(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    keys = left.where(F.col(key).isNotNull()).select(key).distinct()
    return keys.join(right.select(key), key, "left_anti").agg(F.lit(name).alias("check"), F.count("*").alias("violations"))


def repeated_keys(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows beyond the first of each key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).agg(F.lit(name).alias("check"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))


def union_checks(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def trace_counters(rows: DataFrame, labels: DataFrame, events: list[str]) -> DataFrame:
    """Counters of source rows (block_id, label, event_ids, gaps, intervals, latency; lists null where malformed)
    against the label table (block_id, truth: one row per block) and the event dictionary."""
    size = F.size("event_ids")
    known = F.array(*(F.lit(e) for e in events))
    well = F.col("event_ids").isNotNull()
    joined = rows.join(labels, "block_id", "left")
    bad_gap = F.filter("gaps", lambda x: x.isNull() | F.isnan(x) | (x < 0) | (F.abs(x) == float("inf")))
    gap_sum = F.aggregate("gaps", F.lit(0.0), lambda total, x: total + x)
    bad_latency = F.col("latency").isNotNull() & (F.isnan("latency") | (F.col("latency") < 0) | (F.abs("latency") == float("inf")))
    own = counters(
        joined,
        missing_trace_block_ids=F.col("block_id").isNull(),
        unknown_trace_labels=F.col("label").isNull(),
        trace_label_disagreement=F.col("truth").isNotNull() & ~F.col("label").eqNullSafe(F.col("truth")),
        malformed_features=~well,
        empty_traces=well & (size == 0),
        unknown_event_tokens=F.when(well, F.size(F.filter("event_ids", lambda x: ~F.array_contains(known, x)))),
        interval_length_disagreement=well & F.col("gaps").isNotNull() & (F.size("gaps") != F.greatest(size - 1, F.lit(0))),
        invalid_intervals=F.when(F.col("gaps").isNotNull(), F.size(bad_gap)),
        malformed_time_fields=F.col("gaps").isNull(),
        invalid_latency=bad_latency,
        latency_vs_interval_sum_disagreement=F.col("latency").isNotNull() & ~bad_latency & (F.abs(F.col("latency") - gap_sum) > 1e-6),
    )
    return union_checks(
        own,
        repeated_keys(rows, "block_id", "duplicate_trace_block_ids"),
        counters(labels, unknown_ground_truth_labels=F.col("truth").isNull()),
        missing_keys(labels, rows, "block_id", "labels_without_trace"),
        missing_keys(rows, labels, "block_id", "traces_without_labels"),
    )


def matrix_counters(matrix: DataFrame, labels: DataFrame, traces: DataFrame, events: list[str]) -> DataFrame:
    """Counters of a wide occurrence matrix (block_id, label and a column per event) against labels and traces."""
    columns = [c for c in matrix.columns if c not in ("block_id", "label", "type")]
    bad_cell = sum((F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.col(c) < 0) | (F.pmod(F.col(c).cast("double"), F.lit(1.0)) != 0), 1).otherwise(0) for c in columns), F.lit(0))
    joined = matrix.select("block_id", "label", *columns).join(labels, "block_id", "left")
    own = counters(joined, unknown_matrix_labels=~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)), matrix_label_disagreement=~F.col("label").eqNullSafe(F.col("truth")), invalid_matrix_cells=bad_cell)
    row_sum = sum((F.coalesce(F.col(c), F.lit(0)) for c in columns), F.lit(0))
    differs = [F.coalesce(F.size(F.filter("event_ids", lambda x: x == c)), F.lit(-1)) != F.col(c) for c in columns]
    anywhere = (F.size("event_ids") != row_sum) | F.exists(F.array(*differs), lambda x: x)
    against = counters(traces.select("block_id", "event_ids").join(matrix.select("block_id", *columns), "block_id"), trace_matrix_count_disagreement=anywhere)
    spark = matrix.sparkSession
    sets = spark.createDataFrame([("matrix_events_without_template", len({*columns} - {*events})), ("templates_without_matrix_column", len({*events} - {*columns}))], "check string, violations long")
    return union_checks(
        sets,
        own,
        against,
        missing_keys(labels, matrix, "block_id", "labels_without_matrix"),
        missing_keys(matrix, labels, "block_id", "matrix_without_labels"),
        missing_keys(matrix, traces, "block_id", "matrix_without_trace"),
    )


def failed(checks: DataFrame) -> list[str]:
    """Names of the checks with violations; the rows are one per check."""
    return sorted(r["check"] for r in checks.where("violations > 0").collect())


def require(checks: DataFrame) -> None:
    """Raise for the first checks that fail: the strict mode of the same queries."""
    names = failed(checks)
    if names:
        raise ValueError(f"failed checks: {', '.join(names)}")


def same_rows(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Rows that only one of two frames has, counted with repetition."""
    return a.exceptAll(b).select(F.lit(1).alias("x")).unionAll(b.exceptAll(a).select(F.lit(1).alias("x"))).agg(F.lit(name).alias("check"), F.count("*").alias("violations"))
