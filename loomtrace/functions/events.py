"""The event dictionary: which numbers name the same event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.packed import LAST_EVENT, event_values


def template_key(template: Column) -> Column:
    """A template without letter case, blanks and punctuation; null for a text that holds nothing else."""
    return F.nullif(F.regexp_replace(F.lower(template), r"[\s\p{P}\p{S}\p{Z}\p{C}]", ""), F.lit(""))


def same_events(templates: DataFrame, id_col: str = "EventId", template_col: str = "EventTemplate") -> list[int]:
    """For each event number the smallest number that names the same event; place 0 is unused.

    Numbers are the same event when their templates have the same `template_key`, also through other numbers. At
    most `LAST_EVENT` numbers exist, so at most the square of that many rows reach the driver, whatever the table's
    size. Rows whose id is no event id and null templates are ignored; an empty table makes every event its own."""
    number = F.substr(event_values(F.col(id_col)), F.lit(2)).try_cast("int").alias("n")
    keyed = (
        templates.select(number, template_key(F.col(template_col)).alias("k"))
        .where(F.col("n").between(1, LAST_EVENT) & F.col("k").isNotNull())
        .distinct()
    )
    smallest = keyed.groupBy("k").agg(F.min("n").alias("first"))
    pairs = keyed.join(smallest, "k").where("n <> first").select("n", "first").distinct().collect()
    root = list(range(LAST_EVENT + 1))

    def find(n: int) -> int:
        while root[n] != n:
            n = root[n]
        return n

    for n, first in sorted((p["n"], p["first"]) for p in pairs):
        a, b = find(n), find(first)
        root[max(a, b)] = min(a, b)
    return [find(n) for n in range(LAST_EVENT + 1)]
