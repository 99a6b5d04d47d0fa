"""Texts that stop before their writer ended them.

Method: self-join by prefix over sorted values. Texts are cut into segments (sentences and lines) whose numbers are
masked, so that a corpus repeats its segments. All distinct segments are sorted by range, and one pass with a stack
finds for each segment that ends a text how often longer segments start with it: in sorted order everything that starts
with a segment follows it directly. A segment that is still open at the end of a part of the sorted rows is carried over
the border: each part says how many of its rows share how many characters with its first row, and one row per part is
enough to complete the counts of the open ones. So no prefix, however frequent, is gathered in one task. A last segment
without a closing mark is

* cut, if longer segments that start with it are much more frequent than itself (evidence ``prefix``);
* whole, if it is frequent enough as a segment of its own (a sign-off, a status, a complete log line);
* cut, if it is rare and longer segments start with it (``prefix``);
* whole, if it is like no other but its last two words end a frequent one;
* cut otherwise: it stops without closing mark and nothing ever ends like this (``ending``; this is a rule beside the
  method, for texts that no other resembles, and `truncation_by_source` counts its cases apart).

Marks that some systems put after a cut are taken off before; a text that is closed before such a mark is cut too
(``mark``). Only distinct texts count, so copies of a cut text prove nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.packed import let
from loomtrace.session import shared_checkpoint

#: A last segment is an end of its own if it ends at least this share of the distinct texts, and this many, or as often
#: stands inside texts.
END_SHARE, LEAST_ENDS = 2e-4, 3
#: ... and if longer segments that start with it are at most this many times as frequent.
LONGER = 20.0
#: Characters at the end in which a cut mark is looked for.
MARK_SPACE = 80
# Blanks, what systems put after a cut.
BLANKS = " \t\r\n\f\u000b\u00a0\u3000\u2028\u2029"
CUT_MARK = r"(?s)(?:\s*\[\+[^\]\n]{0,40}\]?|\s*\[?(?:\.{2,}|…)\]?(?:\s*\[?(?:\.{2,}|…)\]?)*|\s*[\[(<](?:truncated|cut off|cut|snip|more|continued)[^\n]{0,40})\z"
#: Something to see, so that a text is not blank.
VISIBLE = r"[^\s\p{Z}\p{C}]"
# Marks that close a sentence, and what may stand behind them.
CLOSING, BEHIND_CLOSING = ".!?。！？", "\"'”’»)]"
MARK = "\u0001"


def source_key(source: Column) -> Column:
    """A source without letter case, surrounding blanks and the difference of ``-`` and ``_``; null for a blank one."""
    return F.nullif(F.replace(F.lower(F.btrim(source, F.lit(" \t\r\n"))), F.lit("-"), F.lit("_")), F.lit(""))


def _end(text: Column) -> Column:
    """``closed`` and ``marked`` of a text, and ``joined``: its masked segments in order with `MARK` between. Blanks at the
    end, characters that format only and what was put after a cut, in the last characters, count for nothing; line ends
    with blanks beside them are blanks."""

    def unmarked(t: Column) -> Column:
        space = F.least(F.length(t), F.lit(MARK_SPACE))
        return F.concat(F.left(t, F.length(t) - space), F.regexp_replace(F.right(t, space), CUT_MARK, ""))

    def masked(t: Column) -> Column:
        lines = F.regexp_replace(F.regexp_replace(t, r"\p{Nd}+", "0"), r"(?<=\S)\n+(?=\S)", MARK)
        return F.btrim(F.regexp_replace(F.regexp_replace(lines, r"(?<=[.!?。！？])\s+", MARK), r"\s+", " "))

    def of(t: Column) -> Column:
        last = lambda u: F.right(F.rtrim(u, F.lit(BEHIND_CLOSING)), F.lit(1))
        return let(
            unmarked(t),
            lambda u: F.struct(
                ((last(u) != "") & F.contains(F.lit(CLOSING), last(u))).alias("closed"), (F.length(u) < F.length(t)).alias("marked"), masked(u).alias("joined")
            ),
        )

    return let(F.rtrim(F.regexp_replace(F.translate(text, MARK, " "), r"[\p{Cf}\u0000]", ""), F.lit(BLANKS)), of)


_COUNTED = "kind int, part int, segment string, n long, ends long, longer long, lengths array<int>, totals array<long>"
_FINAL, _OPEN, _FIRST = 0, 1, 2


def _common(a: str, b: str) -> int:
    """How many characters two texts begin alike."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
    names = [x.split()[0] for x in _COUNTED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def _longer_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a part of the sorted (segment, n, ends, part) rows: how often longer segments of the part start with each
    segment that ends a text, finally or, for those open at the part's end, so far; and one row for the part's first
    segment with the sums of n of the rows that share at least so many characters with it."""
    stack: list[list] = []  # segment, n, ends, sum of the longer ones
    done: list[tuple] = []
    first, shared, number, steps = None, 0, 0, {}

    def close() -> None:
        top = stack.pop()
        if stack:
            stack[-1][3] += top[1] + top[3]
        if top[2]:
            done.append((_FINAL, number, *top, None, None))

    for batch in batches:
        for segment, n, ends, part in zip(*(c.to_pylist() for c in batch.columns)):
            if first is None:
                first, shared, number = segment, len(segment), part
            while stack and not segment.startswith(stack[-1][0]):
                close()
            stack.append([segment, n, ends, 0])
            if shared:
                shared = _common(first[:shared], segment)
            steps[shared] = steps.get(shared, 0) + n
        yield _records(done)
        done.clear()
    if first is not None:
        longer = 0
        for segment, n, ends, below in reversed(stack):
            longer += below
            if ends:
                done.append((_OPEN, number, segment, n, ends, longer, None, None))
            longer += n
        done.append((_FIRST, number, first, 0, 0, 0, [*steps], [*steps.values()]))
        yield _records(done)


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The open segments of all parts, in the order of parts, with what later parts add to their counts. Sees one row of
    each part and the segments that are open at its end."""
    open_: list[list] = []
    done: list[tuple] = []
    waiting: list[list] = []
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == _OPEN:
                waiting.append([r["segment"], r["n"], r["ends"], r["longer"]])
                continue
            # the part's first row comes before the segments that are open at its end
            open_, waiting = open_ + waiting, []
            going_on = []
            for x in open_:
                if r["segment"].startswith(x[0]):
                    x[3] += sum(t for length, t in zip(r["lengths"], r["totals"]) if length >= len(x[0]))
                    going_on.append(x)
                else:
                    done.append((_FINAL, 0, *x, None, None))
            open_ = going_on
    yield _records(done + [(_FINAL, 0, *x, None, None) for x in open_ + waiting])


def prefix_counts(segments: DataFrame) -> DataFrame:
    """``segment``, ``n``, ``ends``, ``longer`` of the rows (``segment``, unique and not null, ``n``, ``ends``) with ``ends``
    above 0: how often, by ``n``, longer segments start with each of them."""
    ranged = segments.repartitionByRange("segment").sortWithinPartitions("segment").select("segment", "n", "ends", F.spark_partition_id().alias("part"))
    counted = shared_checkpoint(ranged.mapInArrow(_longer_counts, _COUNTED))
    border = counted.where(F.col("kind") != _FINAL).coalesce(1).sortWithinPartitions("part", F.desc("kind"))
    columns = ("segment", "n", "ends", "longer")
    return counted.where(F.col("kind") == _FINAL).select(*columns).unionByName(border.mapInArrow(_carried, _COUNTED).select(*columns))


def truncated_texts(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), end_share: float = END_SHARE) -> DataFrame:
    """``key``, the columns of ``keep``, ``cut`` BOOLEAN and ``evidence`` STRING of every row: ``prefix``, ``mark`` or
    ``ending`` where the text is cut, else null.

    ``cut`` is false for null, empty and blank texts. Copies of a text get the same answer. Texts of any length are
    used whole. An empty table gives no row."""
    full = F.coalesce(F.col(text).rlike(VISIBLE), F.lit(False))
    # the condition always holds; depending on the partition, it keeps filters from being pushed below, which would
    # repeat the segmentation
    ended = F.when(F.spark_partition_id() >= 0, F.when(full, _end(F.col(text))))
    rows = shared_checkpoint(df.select(key, *keep, F.xxhash64(text).alias("_hash"), ended.alias("_end")))
    distinct = rows.where(F.col("_end").isNotNull()).select("_hash", F.col("_end.joined").alias("joined")).distinct()
    each = distinct.select(F.split("joined", MARK).alias("segments")).select((F.size("segments") - 1).alias("last"), F.posexplode("segments").alias("at", "segment"))
    counted = shared_checkpoint(each.groupBy("segment").agg(F.count("*").alias("n"), F.count_if(F.col("at") == F.col("last")).alias("ends")))
    n_texts = counted.agg(F.sum("ends")).first()[0] or 0
    least = max(float(LEAST_ENDS), end_share * n_texts)
    closed = F.contains(F.lit(CLOSING), F.right(F.rtrim("segment", F.lit(BEHIND_CLOSING)), F.lit(1)))
    compared = prefix_counts(counted.where("segment <> ''").withColumn("ends", F.when(closed, 0).otherwise(F.col("ends"))))
    kind = (
        F.when(F.col("longer") > F.col("n") * LONGER, "prefix").when(F.col("n") >= least, "whole").when(F.col("longer") > 0, "prefix").otherwise("ending")
    )
    verdict = shared_checkpoint(compared.select("segment", kind.alias("verdict")))
    # a segment like no other may still end as whole ones do
    tail = F.regexp_extract("segment", r"(\S+ \S+)\z", 1)
    tails = verdict.where("verdict = 'whole'").select(tail.alias("tail")).where("tail <> ''").distinct().withColumn("known", F.lit(True))
    bad = (
        verdict.withColumn("tail", F.when(F.col("verdict") == "ending", tail)).join(tails, "tail", "left")
        .where((F.col("verdict") != "whole") & F.col("known").isNull()).select("segment", "verdict")
    )
    asked = rows.select(
        key, *keep, F.col("_end.closed").alias("_closed"), F.col("_end.marked").alias("_marked"), F.when(~F.col("_end.closed"), F.element_at(F.split("_end.joined", MARK), -1)).alias("segment")
    )
    evidence = F.when(F.col("_closed"), F.when(F.col("_marked"), "mark")).when(F.col("segment") == "", "ending").otherwise(F.col("verdict"))
    found = asked.join(bad, "segment", "left").select(key, *keep, evidence.alias("evidence"))
    return found.select(key, *keep, F.col("evidence").isNotNull().alias("cut"), "evidence")


def truncation_by_source(found: DataFrame, source: str = "source") -> DataFrame:
    """``source``, ``n_docs``, ``n_cut``, ``share`` of `truncated_texts` rows, and ``by_prefix``, ``by_mark``, ``by_ending``:
    the cut ones by their evidence; null is a source of its own."""
    of = lambda kind: F.count_if(F.col("evidence") == kind).alias(f"by_{kind}")
    return found.groupBy(source_key(F.col(source)).alias("source")).agg(F.count("*").alias("n_docs"), F.count_if("cut").alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("share"), of("prefix"), of("mark"), of("ending"))
