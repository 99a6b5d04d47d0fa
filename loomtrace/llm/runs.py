"""Runs of the same event in event sequences.

Method: boundary interval lookup. The places where a run starts are gathered into one sorted array per chunk, every
event finds its run by binary search among these boundaries, and counts and durations are aggregates over the events of
a run. All steps work on whole columns of a chunk, so a row or an entity may be long: time grows as n log n.

`collapse_runs` takes one sequence per row; a chunk is an Arrow batch of rows and nothing is shuffled.
`collapse_event_rows` takes one event per row: rows are sorted by range over entity and order, so that a chunk is a
part of the sorted rows and an entity of any size is spread over many tasks; of each chunk only the first and last run
of an entity can go on in another chunk, and only these, two per chunk, are joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.session import shared_checkpoint


def _codes(values: pa.Array) -> np.ndarray:
    """Numbers that agree where values agree; every null has a number of its own."""
    nulls = values.null_count
    if pa.types.is_integer(values.type) and not nulls:
        return values.to_numpy(zero_copy_only=False)
    indices = (values if pa.types.is_dictionary(values.type) else values.dictionary_encode()).indices
    codes = pc.fill_null(indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    if nulls:
        codes[codes < 0] = -1 - np.arange(nulls)
    return codes


def _assigned(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted boundaries of a chunk and the run of each of its events."""
    bounds = np.flatnonzero(starts)
    return bounds, np.searchsorted(bounds, np.arange(len(starts)), "right") - 1


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths of lists (0 for null) and their values."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


def _durations(gaps: pa.Array, row: np.ndarray, place: np.ndarray, run: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the gaps inside each run, and whether it is missing."""
    lengths, values = _flat(gaps)
    absent = values.is_null().to_numpy(zero_copy_only=False)
    values = pc.fill_null(values.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    at = (np.cumsum(lengths) - lengths)[row] + place
    inside = np.r_[run[1:] == run[:-1], False] if len(run) else np.zeros(0, bool)
    lacking = inside & (place >= lengths[row])
    there = np.flatnonzero(inside & ~lacking)
    total = np.bincount(run[there], values[at[there]], runs).astype(float)
    missing = np.bincount(run[lacking], minlength=runs) + np.bincount(run[there], absent[at[there]], runs) > 0
    return total, missing | gaps.is_null().to_numpy(zero_copy_only=False)[row[np.searchsorted(run, np.arange(runs))]]


def collapse_runs(df: DataFrame, events: str, gaps: str | None = None, at_least: int = 1) -> DataFrame:
    """One row per run: the columns of ``df`` with ``first_pos``, ``last_pos`` INT, ``event``, ``n_events`` INT and
    ``duration`` DOUBLE in place of the two list columns.

    ``events`` is an array of any simple type; ``gaps[i]`` is the time from event i to event i + 1, so a run's duration
    is the sum of the gaps inside it (0 for a single event). ``duration`` is null without ``gaps``, where the gaps are
    null and where one inside the run is missing. A null event is a run of its own. Runs shorter than ``at_least`` give
    no row, neither do rows whose events are null or empty. Repeated rows give their runs each. Columns of ``df`` with
    a name of the result are dropped."""
    kept = [c for c in df.columns if c not in (events, gaps, "first_pos", "last_pos", "event", "n_events", "duration")]
    event_type = df.schema[events].dataType.elementType
    taken = df.select(*(F.col(f"`{c}`") for c in kept), F.col(events).alias("_events"), (F.col(gaps).cast("array<double>") if gaps else F.lit(None).cast("array<double>")).alias("_gaps"))
    n = len(kept)
    schema = df.select(*(F.col(f"`{c}`") for c in kept)).schema.add("first_pos", "integer").add("last_pos", "integer").add("event", event_type).add("n_events", "integer").add("duration", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, values = _flat(batch.column(n))
            row = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(row)) - (np.cumsum(lengths) - lengths)[row]
            codes = _codes(values)
            starts = place == 0
            starts[1:] |= codes[1:] != codes[:-1]
            bounds, of = _assigned(starts)
            count = np.bincount(of, minlength=len(bounds))
            total, missing = _durations(batch.column(n + 1), row, place, of, len(bounds))
            chosen = np.flatnonzero(count >= at_least)
            at = bounds[chosen]
            rows = pa.array(row[at])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).take(rows) for i in range(n)),
                    pa.array(place[at], pa.int32()),
                    pa.array(place[at] + count[chosen] - 1, pa.int32()),
                    values.take(pa.array(at)),
                    pa.array(count[chosen], pa.int32()),
                    pa.array(total[chosen], pa.float64(), mask=missing[chosen]),
                ],
                names=[f.name for f in schema.fields],
            )

    return taken.mapInArrow(run, schema)


def collapse_event_rows(df: DataFrame, entity: str, order: str, event: str, tie: str, at_least: int = 1) -> DataFrame:
    """Runs of a table with one event per row: ``entity``, ``first``, ``last`` (the least and largest ``order`` of the
    run), ``event``, ``n_events`` BIGINT, all under these names.

    Events of an entity stand in the order of ``order``, then of ``tie``, which must leave no ties for a stable result.
    Rows with a null entity or order are left out; a null event is a run of its own. Other columns are ignored. Runs
    shorter than ``at_least`` give no row; an empty table gives none."""
    rows = df.where(F.col(entity).isNotNull() & F.col(order).isNotNull()).select(F.col(entity).alias("entity"), F.col(order).alias("at"), F.col(event).alias("event"), F.col(tie).alias("tie"))
    ranged = rows.repartitionByRange("entity", "at", "tie").sortWithinPartitions("entity", "at", "tie").drop("tie")
    # ranges are drawn from a sample, so a second evaluation could cut elsewhere
    placed = shared_checkpoint(ranged.withColumn("_part", F.spark_partition_id()))
    kinds = {f.name: f.dataType for f in placed.schema.fields}
    schema = placed.select("entity", F.col("at").alias("first"), F.col("at").alias("last"), "event").schema
    for name, kind in (("n_events", "long"), ("part", "integer"), ("opens", "boolean"), ("closes", "boolean")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs of a part of the sorted rows; ``opens`` and ``closes`` mark an entity's first and last of the part."""
        open_run: pa.Table | None = None  # the last run so far, which the next batch may go on with

        def shown(table: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from table.combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            who, what = _codes(batch.column(0)), _codes(batch.column(2))
            starts = np.ones(len(who), bool)
            starts[1:] = (who[1:] != who[:-1]) | (what[1:] != what[:-1])
            bounds, of = _assigned(starts)
            count = np.bincount(of)
            ends = bounds + count - 1
            first, last = pa.array(bounds), pa.array(ends)
            opens = np.r_[True, who[bounds[1:]] != who[bounds[:-1]]]
            made = pa.table(
                [batch.column(0).take(first), batch.column(1).take(first), batch.column(1).take(last), batch.column(2).take(first), pa.array(count), batch.column(3).take(first), pa.array(opens), pa.array(np.zeros(len(bounds), bool))],
                names=[f.name for f in schema.fields],
            )
            if open_run is not None:
                one, next_one = open_run.to_pylist()[0], made.slice(0, 1).to_pylist()[0]
                if one["entity"] != next_one["entity"]:
                    one["closes"] = True
                elif one["event"] == next_one["event"] and one["event"] is not None:
                    next_one |= {"first": one["first"], "n_events": one["n_events"] + next_one["n_events"], "opens": one["opens"]}
                    one = None
                else:
                    next_one["opens"] = False
                made = pa.concat_tables([pa.Table.from_pylist([next_one], made.schema), made.slice(1)])
                if one is not None:
                    made = pa.concat_tables([pa.Table.from_pylist([one], made.schema), made])
            opened = made["opens"].to_numpy(zero_copy_only=False)
            closes = made["closes"].to_numpy(zero_copy_only=False).copy()
            closes[:-1] |= opened[1:]
            made = made.set_column(7, "closes", pa.array(closes))
            open_run = made.slice(len(made) - 1)
            yield from shown(made.slice(0, len(made) - 1))
        if open_run is not None:
            yield from shown(open_run.set_column(7, "closes", pa.array([True])))

    parts = placed.select("entity", "at", "event", "_part").mapInArrow(run, schema)
    parts = shared_checkpoint(parts)
    # the first and last runs of the parts of entities that are in several; at most two per part
    border = F.col("opens") | F.col("closes")
    several = parts.where("opens").groupBy("entity").agg(F.count("*").alias("n")).where("n > 1").select("entity", F.lit(True).alias("several"))
    marked = parts.join(several, "entity", "left")
    inner = marked.where(F.col("several").isNull() | ~border)
    by_entity = Window.partitionBy("entity").orderBy("part", "first", F.desc("opens"))
    same = (F.lag("event").over(by_entity) == F.col("event")) & F.lag("closes").over(by_entity) & F.col("opens")
    joined = marked.where(F.col("several") & border).withColumn("fresh", F.when(same, 0).otherwise(1))
    joined = joined.withColumn("run", F.sum("fresh").over(by_entity.rowsBetween(Window.unboundedPreceding, 0)))
    merged = joined.groupBy("entity", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("event").alias("event"), F.sum("n_events").alias("n_events"))
    columns = ("entity", "first", "last", "event", "n_events")
    return inner.select(*columns).unionByName(merged.select(*columns)).where(F.col("n_events") >= at_least)
