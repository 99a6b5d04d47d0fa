"""Metrics of predictions, summaries of runs, tuning choices and the comparison report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VALID = ("NORMAL", "ANOMALY")
# Order of methods and knowledge bases in reports.
METHOD_ORDER = {"m0": 0, "m1": 1, "m2": 2, "m3": 3, "m4": 4, "m5": 5}
KB_ORDER = {"normal": 0, "anomaly": 1, "mixed": 2}


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def confusion(df: DataFrame, *by: str, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts and rates of each group, in one aggregation.

    Precision, recall and F1 are null where any prediction is neither NORMAL nor ANOMALY (null counts as such), and 0
    where their denominator is 0."""
    actual, said = F.col(label), F.col(prediction)
    invalid = ~F.coalesce(said.isin(*VALID), F.lit(False))
    both = lambda a, p: F.count_if((actual == a) & (said == p))
    made = df.groupBy(*by).agg(
        F.count("*").alias("queries"), F.count_if(actual == "NORMAL").alias("Normal"), F.count_if(actual == "ANOMALY").alias("Anomaly"),
        both("ANOMALY", "ANOMALY").alias("TP"), both("NORMAL", "NORMAL").alias("TN"), both("NORMAL", "ANOMALY").alias("FP"), both("ANOMALY", "NORMAL").alias("FN"),
        F.count_if(invalid & (actual == "NORMAL")).alias("invalid_normal"), F.count_if(invalid & (actual == "ANOMALY")).alias("invalid_anomaly"), F.count_if(invalid).alias("_invalid"),
    )
    p, r = _ratio(F.col("TP"), F.col("TP") + F.col("FP")), _ratio(F.col("TP"), F.col("TP") + F.col("FN"))
    sound = F.col("_invalid") == 0
    return (
        made.withColumns({"invalid_output_rate": _ratio(F.col("_invalid"), F.col("queries")), "precision": F.when(sound, p), "recall": F.when(sound, r)})
        .withColumn("f1", F.when(sound, _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))
        .drop("_invalid")
    )


def run_summary(df: DataFrame, *by: str) -> DataFrame:
    """`confusion` with the averages of a run; rows have context_count, prompt_tokens, request_count, latency_seconds,
    query_seconds_uncached, cache_hit, new_api_calls, candidate_count and filtered_out. Averages leave nulls out; tokens
    are a ratio of sums over the rows that asked."""
    asked = F.col("prompt_tokens").isNotNull() & (F.coalesce("request_count", F.lit(0)) > 0)
    extra = df.groupBy(*by).agg(
        F.avg("context_count").alias("average_contexts"),
        F.coalesce(F.try_divide(F.sum(F.when(asked, F.col("prompt_tokens"))).cast("double"), F.sum(F.when(asked, F.col("request_count")))), F.lit(0.0)).alias("average_prompt_tokens"),
        F.avg("latency_seconds").alias("average_latency_seconds_uncached"), F.avg("query_seconds_uncached").alias("average_query_seconds_uncached"),
        F.count_if("cache_hit").alias("cache_hits"), F.coalesce(F.sum("new_api_calls"), F.lit(0)).alias("new_api_calls"),
        F.try_divide(F.sum("filtered_out").cast("double"), F.sum("candidate_count")).alias("candidate_removal_rate"),
    )
    rates = confusion(df, *by)
    return rates.join(extra, [rates[c].eqNullSafe(extra[c]) for c in by]).drop(*(extra[c] for c in by)) if by else rates.join(F.broadcast(extra))


def context_distribution(df: DataFrame, *by: str) -> DataFrame:
    """Queries by their number of contexts, as a map of each group."""
    counted = df.groupBy(*by, "context_count").agg(F.count("*").alias("n"))
    entries = F.sort_array(F.collect_list(F.struct(F.col("context_count").cast("string").alias("k"), F.col("n").alias("v"))))
    return counted.groupBy(*by).agg(F.map_from_entries(entries).alias("context_count_distribution"))


def best_k(df: DataFrame) -> DataFrame:
    """The k with the largest F1, then recall, then the smallest k."""
    return df.agg(F.max_by("k", F.struct("f1", "recall", (-F.col("k")).alias("s"))).alias("k"))


def best_threshold(df: DataFrame) -> DataFrame:
    """The threshold with the largest F1 to six decimals, then fewest contexts, then the smallest threshold."""
    key = F.struct(F.round("f1", 6).alias("f"), (-F.col("average_contexts")).alias("c"), (-F.col("threshold")).alias("t"))
    return df.agg(F.max_by(F.struct("quantile", "threshold", "f1", "average_contexts"), key).alias("x")).select("x.*")


def comparison_report(runs: DataFrame, sweep: Sequence[int]) -> DataFrame:
    """Runs (model_profile, method, retrieval, selection, kb, context_setting, contexts, confusion and average_contexts)
    with adaptive runs set against the fixed ones of the same model, retrieval and knowledge base: the one with the
    most contexts and the best one; with flags for the best run of a method and of all. Tuning runs must be marked by
    ``is_tuning_run`` and are left out."""
    runs = runs.where(~F.coalesce("is_tuning_run", F.lit(False))).drop("is_tuning_run")
    most = max(sweep)
    key = ("model_profile", "retrieval", "kb")
    fixed = runs.where("selection = 'fixed'")
    against = fixed.groupBy(*key).agg(
        F.max(F.when(F.col("contexts") == most, F.col("f1"))).alias("fixed_kmax_f1"),
        F.max_by(F.struct("f1", "context_setting"), F.when(F.col("f1").isNotNull(), F.struct("f1", (-F.col("contexts")).alias("c")))).alias("_best"),
    )
    adaptive = F.col("selection") == "adaptive"
    joined = runs.join(against, [runs[c].eqNullSafe(against[c]) for c in key], "left").drop(*(against[c] for c in key))
    kept = {
        "context_reduction_vs_fixed_contexts": F.when(adaptive & F.col("average_contexts").isNotNull(), 1 - F.col("average_contexts") / most).otherwise(0.0),
        "fixed_kmax_f1": F.when(adaptive, F.col("fixed_kmax_f1")),
        "best_fixed_f1": F.when(adaptive, F.col("_best.f1")),
        "best_fixed_context_setting": F.when(adaptive, F.col("_best.context_setting")),
        "confusion_matrix": F.format_string("TN=%d FP=%d FN=%d TP=%d", "TN", "FP", "FN", "TP"),
    }
    deltas = {"delta_f1_vs_fixed_kmax": F.col("f1") - F.col("fixed_kmax_f1"), "delta_f1_vs_best_fixed": F.col("f1") - F.col("best_fixed_f1")}
    flags = {
        "best_in_method_kb": F.coalesce(F.col("f1") == F.max("f1").over(Window.partitionBy("model_profile", "method", "kb")), F.lit(False)),
        "best_overall": F.coalesce(F.col("f1") == F.max("f1").over(Window.partitionBy(F.lit(1))), F.lit(False)),  # one row per run
    }
    return joined.withColumns(kept).withColumns(deltas).withColumns(flags).drop("_best")


def report_order(df: DataFrame) -> DataFrame:
    """Rows of a report in reading order, unknown methods last, runs without knowledge base or contexts first."""
    place = lambda c, order: F.element_at(F.create_map(*(F.lit(x) for pair in order.items() for x in pair)), F.col(c))
    return df.orderBy(F.coalesce(place("method", METHOD_ORDER), F.lit(99)), F.coalesce(place("kb", KB_ORDER), F.lit(-1)), F.coalesce("contexts", F.lit(-1)), F.col("context_setting").asc_nulls_last())


def heat_pivot(df: DataFrame, rows: str, columns: str, values: Sequence[str], value: str = "f1") -> DataFrame:
    """The largest value of each row for each of the given column values."""
    return df.groupBy(rows).pivot(columns, list(values)).agg(F.max(value))


def confusion_rows(df: DataFrame, *keep: str) -> DataFrame:
    """A confusion matrix as rows ``actual``, ``predicted``, ``n``."""
    cells = [("NORMAL", "NORMAL", "TN"), ("NORMAL", "ANOMALY", "FP"), ("ANOMALY", "NORMAL", "FN"), ("ANOMALY", "ANOMALY", "TP")]
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n")) for a, p, c in cells)))
    return df.select(*keep, each.alias("x")).select(*keep, "x.*")


def experiment_id(*parts: str) -> Column:
    """Names joined by ``_``, nulls left out, slashes as hyphens."""
    return F.replace(F.concat_ws("_", *(F.col(p).cast("string") for p in parts)), F.lit("/"), F.lit("-"))
