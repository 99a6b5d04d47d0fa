"""Typed traces from packed fields, the rows that cannot be read with their reason, and one row per packed value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.packed import event_numbers, event_values, gap_numbers, is_plain, number_values

#: Seconds by which the stated latency may differ from the sum of the gaps.
LATENCY_TOLERANCE = 1e-6
# The columns of a delivered trace line, in order.
LINE_FIELDS = ("BlockId", "Label", "Type", "Features", "TimeInterval", "Latency")

_LATENCY_TEXT = r"^[\s\u00a0]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[\s\u00a0]*\z"


def latency_number(text: Column) -> Column:
    """A decimal number, exponents and surrounding blanks allowed, as a double; null for anything else."""
    return F.when(text.rlike(_LATENCY_TEXT), F.btrim(text, F.lit(" \t\r\n\f\u000b\u00a0")).try_cast("double"))


def _reasons(events: Column, gaps: Column, gap_sum: Column, latency: Column) -> Column:
    """The rules that a trace breaks, in the order in which they count."""
    bad_events = events.isNull() | (F.size(events) == 0) | F.exists(events, lambda x: x.isNull())
    bad_gaps = gaps.isNull() | gap_sum.isNull() | (gap_sum == float("inf")) | (F.size(gaps) != F.size(events) - 1)
    bad_latency = latency.isNull() | F.isnan(latency) | (latency < 0) | (latency == float("inf")) | (F.abs(latency - gap_sum) > LATENCY_TOLERANCE)
    rules = (("features", bad_events), ("interval", bad_gaps), ("latency", bad_latency))
    return F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules)))


def typed_traces(
    df: DataFrame,
    features: str = "Features",
    interval: str = "TimeInterval",
    latency: str = "Latency",
    names: Sequence[int] | None = None,
) -> DataFrame:
    """Add to each row the typed columns of its trace and the rules it breaks.

    Added: ``_events`` ARRAY<INT> (numbers, replaced by ``names`` where given), ``_gaps`` ARRAY<DOUBLE>, ``_latency``
    DOUBLE, ``_reasons`` ARRAY<STRING> (empty for a valid row; the first is the row's reason), and the texts
    ``_event_values`` and ``_gap_values`` in plain spelling. Columns of these names in ``df`` are replaced, all
    others are kept. Nothing is shuffled; every null, empty, overlong or unreadable field gives a reason, never an
    error. An empty table stays empty."""
    is_text = dict(df.dtypes)[latency] == "string"
    return (
        df.withColumns({"_event_values": event_values(F.col(features)), "_gap_values": number_values(F.col(interval))})
        .withColumns(
            {
                "_events": event_numbers(F.col("_event_values"), names),
                "_gaps": gap_numbers(F.col("_gap_values")),
                "_latency": latency_number(F.col(latency)) if is_text else F.col(latency).cast("double"),
            }
        )
        .withColumn("_gap_sum", F.aggregate("_gaps", F.lit(0.0), lambda total, x: total + x))
        # the condition always holds; depending on the partition, it keeps filters above from being pushed below, where
        # every list would be read again at each place that names it
        .withColumn("_reasons", F.when(F.spark_partition_id() >= 0, _reasons(F.col("_events"), F.col("_gaps"), F.col("_gap_sum"), F.col("_latency"))))
        .drop("_gap_sum")
    )


def line_fields(df: DataFrame, line: str = "line") -> DataFrame:
    """Split delivered CSV lines into their fields by RFC 4180, one line per row.

    The line is split on double quotes: even pieces stand outside quotes, odd pieces inside; an empty even piece
    between two odd ones is an escaped quote. Added: ``_fields`` ARRAY<STRING> with every column as nullable text,
    and ``_quoting`` BOOLEAN, true where a quote stands where none is allowed or a quoted field never closes. One
    line end at the line's end is no part of the last field. A null line has no field."""
    text = F.translate(F.regexp_replace(F.col(line), r"(?:\r\n|\n|\r)\z", ""), "\u0001", "\u001a")
    pieces = F.col("_pieces")
    last = F.size(pieces) - 1
    misplaced = F.exists(
        F.sequence(F.lit(0), last),
        lambda i: (i % 2 == 0)
        & (F.get(pieces, i) != "")
        & (((i > 0) & ~F.get(pieces, i).startswith(",")) | ((i < last) & ~F.get(pieces, i).endswith(","))),
    )
    joined = F.array_join(
        F.transform(
            pieces,
            lambda p, i: F.when(i % 2 == 1, p).when((p == "") & (i > 0) & (i < last), F.lit('"')).otherwise(F.translate(p, ",", "\u0001")),
        ),
        "",
    )
    return (
        df.withColumn("_pieces", F.split(text, '"', -1))
        .withColumns({"_quoting": F.coalesce((last % 2 == 1) | misplaced, F.lit(False)), "_fields": F.split(joined, "\u0001", -1)})
        .drop("_pieces")
    )


def typed_lines(df: DataFrame, line: str = "line", names: Sequence[int] | None = None) -> DataFrame:
    """Typed traces of delivered CSV lines: `line_fields`, then `typed_traces` of the named fields.

    Besides the columns of `typed_traces` each row gets its six fields as text under the names of `LINE_FIELDS`;
    ``_reasons`` begins with ``quoting`` or ``columns`` where the line itself is broken. A null line breaks
    ``columns``."""
    split = line_fields(df, line)
    fields = {name: F.get("_fields", F.lit(i)) for i, name in enumerate(LINE_FIELDS)}
    shape = F.array_compact(
        F.array(
            F.when(F.col("_quoting"), F.lit("quoting")),
            F.when(F.coalesce(F.size("_fields") != len(LINE_FIELDS), F.lit(True)) | F.col("_fields").isNull(), F.lit("columns")),
        )
    )
    typed = typed_traces(split.withColumns(fields), names=names)
    return typed.withColumn("_reasons", F.concat(shape, "_reasons")).drop("_fields", "_quoting")


def rejected(typed: DataFrame) -> DataFrame:
    """The rows that break a rule, with their first ``reason``."""
    return typed.where(F.size("_reasons") > 0).withColumn("reason", F.get("_reasons", F.lit(0)))


def accepted(typed: DataFrame) -> DataFrame:
    """The rows that break no rule."""
    return typed.where(F.size("_reasons") == 0)


def packed_values(typed: DataFrame, keep: Sequence[str], features: str = "Features", interval: str = "TimeInterval", only_packed: bool = False) -> DataFrame:
    """One row per value of the packed fields of valid rows, with its place.

    Columns: those of ``keep``, ``field``, ``pos`` INT from 0, ``value`` STRING (an id in plain spelling, or a gap
    with three decimals, rounded half up). ``only_packed`` leaves out fields that are plain lists already. Rows that
    break a rule and empty lists give no row. The values of one row stay in one task; nothing is shuffled."""
    gap = lambda x: F.coalesce(x.try_cast("decimal(38,3)").cast("string"), F.format_string("%.3f", x.try_cast("double")))
    event = lambda n: F.concat(F.lit("E"), n.cast("string"))

    def field(name: str, source: str, values: str, spelled: Column) -> Column:
        wanted = ~is_plain(F.col(source), F.col(values)) if only_packed else F.lit(True)
        return F.when((F.size("_reasons") == 0) & wanted, F.struct(F.lit(name).alias("field"), spelled.alias("values")))

    lists = F.array_compact(
        F.array(
            field("Features", features, "_event_values", F.transform("_events", event)),
            field("TimeInterval", interval, "_gap_values", F.when(F.col("_gap_values") == "", F.array().cast("array<string>")).otherwise(F.transform(F.split("_gap_values", ","), gap))),
        )
    )
    return (
        typed.select(*keep, F.explode(lists).alias("_list"))
        .select(*keep, F.col("_list.field").alias("field"), F.posexplode("_list.values").alias("pos", "value"))
        .select(*keep, "field", "pos", "value")
    )
