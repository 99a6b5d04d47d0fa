"""Ordered event patterns, with gaps, that many entities' sequences hold.

Method: pivot-item partitioning. Items are ordered by the number of entities that hold them. A pattern belongs to its
rarest item, the pivot; every sequence's relevant part, rewritten without the items rarer than the pivot and without
infrequent ones, goes to the partition of each frequent pivot that it holds, and there only patterns containing the
pivot are counted.

Scale. An entity's distinct sequences form a unit, equal units are counted once with a weight, and large pivots are
spread over several partitions by a hash of the unit. Since a partition then sees a part of a pivot's units, it
counts every candidate and the sums are held against the threshold afterwards. Candidates are bounded by the
alphabet: at most ``LAST_EVENT`` items, and only extensions by pairs that are frequent everywhere. An entity with
more than ``MAX_UNIT`` distinct sequences is not gathered: each of its sequences goes to its pivots' partitions by
itself, wherever its hash sends it, and the distinct patterns of an entity, which the frequent pairs bound, are counted
once. Both ways prune by the same counts, taken over all entities, so they find the same patterns. Only counts of items
and ordered pairs reach the driver (at most 29 and 841 of each source).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.session import shared_checkpoint

#: One letter for each event number, so that a sequence is a short text.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabc"
#: Distinct sequences of one entity that are gathered into one unit; those of larger entities are units of their own.
MAX_UNIT = 64
#: Units of one pivot that go to one partition.
UNITS_A_PARTITION = 400_000
#: Cells of a successor table that a task holds at once.
TABLE_CELLS = 6_000_000


def letters_of(events: Column) -> Column:
    """A sequence as text, one letter an event; null for null, unknown events are left out."""
    table = F.array(F.lit(None).cast("string"), *(F.lit(x) for x in LETTERS))
    return F.array_join(F.transform(events, lambda n: F.get(table, n)), "")


class Sequences:
    """Sequences over a small alphabet with, for each place, where each item comes next."""

    def __init__(self, grid: np.ndarray, units: np.ndarray | None, weights: np.ndarray, n_items: int):
        """``grid``: items by row and place, -1 behind a sequence's end; ``units``: the unit of each row, ascending, or
        None where each row is one."""
        rows, length = grid.shape
        self.after = np.zeros((rows, length + 1, n_items), np.int32 if length > 30_000 else np.int16)
        every = np.arange(rows)
        for place in range(length - 1, -1, -1):
            now = self.after[:, place]
            now[:] = self.after[:, place + 1]
            here = grid[:, place]
            if (here >= 0).all():
                now[every, here] = place + 1
            else:
                some = np.flatnonzero(here >= 0)
                now[some, here[some]] = place + 1
        self.units, self.weights = units, weights

    def held(self, base: np.ndarray, ends: np.ndarray, item: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The next place of each item after ``ends``, 0 for none, and the weight of the units that have it; only of
        one item where it is given. ``base`` is where a row begins in the flat table."""
        n_items = self.after.shape[2]
        if item is None:
            after = self.after.reshape(-1, n_items).take(base + ends, axis=0)
        else:
            after = self.after.ravel().take((base + ends) * n_items + item)[:, None]
        has = after > 0
        rows = base // self.after.shape[1]
        if self.units is None:
            return after, self.weights.take(rows) @ has
        unit = self.units[rows]
        starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        return after, self.weights[rows[starts]] @ np.logical_or.reduceat(has, starts, axis=0)


def _sequences(units: list[str], weights: np.ndarray, index: dict[str, int], needed: str | None, shortest: int) -> Iterator[Sequences]:
    """The units' sequences, sorted by length, in parts of bounded size; units of several sequences stay together."""
    table = np.full(128, -1, np.int16)
    for letter, i in index.items():
        table[ord(letter)] = i
    n_items = len(index)

    def grid(texts: list[str]) -> np.ndarray:
        return table[np.array(texts, "S").view(np.uint8).reshape(len(texts), -1)]

    single, several = [], []
    for u, unit in enumerate(units):
        (several if " " in unit else single).append(u)
    if single:
        texts = [units[u] for u in single]
        own = np.asarray(weights, np.float64)[single]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(lengths, kind="stable")
        order = order[np.searchsorted(lengths[order], shortest) :]
        at = 0
        while at < len(order):
            fits = np.arange(1, len(order) - at + 1) * (lengths[order[at:]] + 1) * n_items <= TABLE_CELLS
            part = order[at : at + max(1, int(fits.argmin()) if not fits.all() else len(fits))]
            yield Sequences(grid([texts[i] for i in part]), None, own[part], n_items)
            at += len(part)
    texts, of, longest = [], [], 0
    for u in sorted(several, key=lambda u: len(units[u])):
        own_texts = [x for x in {*units[u].split(" ")} if len(x) >= shortest and (needed is None or needed in x)]
        if not own_texts:
            continue
        longest = max(longest, *map(len, own_texts))
        if texts and (len(texts) + len(own_texts)) * (longest + 1) * n_items > TABLE_CELLS:
            yield Sequences(grid(texts), np.array(of), np.asarray(weights, np.float64)[of], n_items)
            texts, of = [], []
        texts += own_texts
        of += [u] * len(own_texts)
    if texts:
        yield Sequences(grid(texts), np.array(of), np.asarray(weights, np.float64)[of], n_items)


def _count(seqs: Sequences, pairs: np.ndarray, pivot: int, lengths: tuple[int, ...], found: dict[tuple[int, ...], float]) -> None:
    """Add to ``found`` the weights of the patterns that contain ``pivot``."""
    longest = max(lengths)

    def grow(pattern: tuple[int, ...], base: np.ndarray, ends: np.ndarray, allowed: np.ndarray, has_pivot: bool) -> None:
        size = len(pattern) + 1
        if not has_pivot and size == longest:  # only the pivot can follow
            count = seqs.held(base, ends, pivot)[1][0]
            if count:
                found[*pattern, pivot] = found.get((*pattern, pivot), 0) + count
            return
        after, counts = seqs.held(base, ends)
        for item in np.flatnonzero(allowed & (counts > 0)).tolist():
            now = has_pivot or item == pivot
            longer = (*pattern, item)
            if now and size in lengths:
                found[longer] = found.get(longer, 0) + counts[item]
            if size < longest:
                onward = allowed & pairs[item]
                if onward.any() and (now or onward[pivot]):
                    column = after[:, item]
                    keep = np.flatnonzero(column)
                    grow(longer, base.take(keep), column.take(keep).astype(np.int64), onward, now)

    n, width = seqs.after.shape[:2]
    grow((), np.arange(n, dtype=np.int64) * width, np.zeros(n, np.int64), np.ones(pairs.shape[0], bool), False)


def _pair_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    index = {x: i for i, x in enumerate(LETTERS)}
    n = len(LETTERS)
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for src, part in batch.groupby("src"):
            sums = total.setdefault(src, np.zeros((n, n)))
            for seqs in _sequences(part["unit"].tolist(), part["w"].to_numpy(), index, None, 2):
                base = np.arange(len(seqs.after), dtype=np.int64) * seqs.after.shape[1]
                first = seqs.after[:, 0]
                for item in range(n):
                    keep = np.flatnonzero(first[:, item])
                    if len(keep):
                        sums[item] += seqs.held(base[keep], first[keep, item].astype(np.int64))[1]
    for src, sums in total.items():
        a, b = np.nonzero(sums)
        yield pd.DataFrame({"src": src, "a": a, "b": b, "w": sums[a, b].astype(np.int64)})


def frequent_patterns(df: DataFrame, min_share: float, lengths: tuple[int, ...] = (3, 4), max_unit: int = MAX_UNIT) -> DataFrame:
    """``src``, ``pattern``, ``support`` of the patterns that at least ``min_share`` of a source's entities hold.

    ``df`` has ``src``, ``entity`` and ``events`` (ARRAY<INT> of numbers 1 to 29). An entity holds a pattern if one of
    its rows holds the pattern's events in that order, with any events between; each step takes a place of its own.
    ``pattern`` joins event names by ``>``. Rows with null entity or null events are no rows of an entity; an entity
    with an empty row counts as an entity. Repeated rows change nothing. Columns other than the three are ignored. An
    empty table gives no row."""
    longest, shortest = max(lengths), min(lengths)
    rows = shared_checkpoint(df.where(F.col("entity").isNotNull() & F.col("events").isNotNull()).select("src", "entity", letters_of(F.col("events")).alias("seq")))
    entities = shared_checkpoint(rows.groupBy("src", "entity").agg(F.min("seq").alias("seq"), F.max("seq").alias("last")))
    several = entities.where("seq <> last").select("src", "entity")
    distinct = rows.join(several, ["src", "entity"], "left_semi").distinct()
    sizes = distinct.groupBy("src", "entity").agg(F.count("*").alias("n"))
    few, many = (distinct.join(sizes.where(F.col("n") <= max_unit if small else F.col("n") > max_unit), ["src", "entity"]) for small in (True, False))
    gathered = few.groupBy("src", "entity").agg(F.array_join(F.sort_array(F.collect_list("seq")), " ").alias("unit"))
    units = shared_checkpoint(
        entities.where("seq = last").select("src", F.col("seq").alias("unit")).unionByName(gathered.select("src", "unit")).groupBy("src", "unit").agg(F.count("*").alias("w"))
    )

    large = shared_checkpoint(many.select("src", "entity", F.col("seq").alias("unit")))
    totals = {r["src"]: r["n"] for r in entities.groupBy("src").agg(F.count("*").alias("n")).collect()}
    need = {src: max(1, math.ceil(n * min_share - 1e-9)) for src, n in totals.items()}

    own_items = F.explode(F.array_distinct(F.split(F.replace("unit", F.lit(" "), F.lit("")), ""))).alias("item")
    large_items = large.select("src", "entity", own_items).distinct().select("src", F.lit(1).cast("long").alias("w"), "item")
    items = units.select("src", "w", own_items).unionByName(large_items).where("item <> ''")
    item_rows = items.groupBy("src", "item").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()
    large_pairs = _spread(large, "src", "entity").mapInPandas(_entity_pairs, "src string, entity string, a int, b int").distinct().select("src", "a", "b", F.lit(1).cast("long").alias("w"))
    pair_rows = units.mapInPandas(_pair_counts, "src string, a int, b int, w long").unionByName(large_pairs).groupBy("src", "a", "b").agg(F.sum("w").alias("w")).collect()

    plan: dict[str, tuple[str, np.ndarray]] = {}
    parts, large_parts = [], []
    for src, n in need.items():
        order = [r for r in sorted(item_rows, key=lambda r: (-r["w"], r["item"])) if r["src"] == src and r["w"] >= n]
        alphabet = "".join(r["item"] for r in order)
        where = {x: i for i, x in enumerate(alphabet)}
        pairs = np.zeros((len(alphabet), len(alphabet)), bool)
        for r in pair_rows:
            a, b = LETTERS[r["a"]], LETTERS[r["b"]]
            if r["src"] == src and r["w"] >= n and a in where and b in where:
                pairs[where[a], where[b]] = True
        plan[src] = (alphabet, pairs)
        routes = []
        for i, r in enumerate(order):
            dropped = "".join(x for x in LETTERS if x not in alphabet[: i + 1])
            rewritten = F.translate("unit", dropped, "") if dropped else F.col("unit")
            spread = math.ceil(r["n"] / UNITS_A_PARTITION)
            salt = F.pmod(F.xxhash64(rewritten), F.lit(spread)).cast("int") if spread > 1 else F.lit(0)
            routes.append(F.when(F.contains("unit", F.lit(r["item"])), F.struct(F.lit(i).alias("pivot"), salt.alias("salt"), rewritten.alias("unit"))))
        if routes:
            for rows_of, also, into in ((units, "w", parts), (large, "entity", large_parts)):
                routed = rows_of.where(F.col("src") == src).select("src", also, F.explode(F.array_compact(F.array(*routes))).alias("r")).select("src", also, "r.*")
                into.append(routed.where(F.length("unit") >= shortest))
    if not parts:
        return units.select("src", F.lit("").alias("pattern"), F.col("w").alias("support")).where("false")

    def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[str, int], dict[tuple[int, ...], float]] = {}
        waiting: dict[tuple[str, int], tuple[list, list]] = {}

        def flush(key: tuple[str, int]) -> None:
            src, pivot = key
            alphabet, pairs = plan[src]
            texts, weights = waiting.pop(key)
            own = pd.Series(np.concatenate(weights)).groupby(np.concatenate(texts)).sum()
            index = {x: i for i, x in enumerate(alphabet[: pivot + 1])}
            for seqs in _sequences(own.index.tolist(), own.to_numpy(), index, alphabet[pivot], shortest):
                _count(seqs, pairs[: pivot + 1, : pivot + 1], pivot, lengths, found.setdefault(key, {}))

        for batch in batches:
            for key, part in batch.groupby(["src", "pivot"], sort=False):
                texts, weights = waiting.setdefault(key, ([], []))
                texts.append(part["unit"].to_numpy())
                weights.append(part["w"].to_numpy())
                if sum(map(len, texts)) > 100_000:
                    flush(key)
            for key in [k for k in waiting if k != (batch["src"].iloc[-1], batch["pivot"].iloc[-1])]:  # sorted: no more of it comes
                flush(key)
        for key in [*waiting]:
            flush(key)
        for (src, _), counts in found.items():
            alphabet = plan[src][0]
            if counts:
                yield pd.DataFrame({"src": src, "pattern": ["".join(alphabet[i] for i in p) for p in counts], "n": np.rint([*counts.values()]).astype(np.int64)})

    def of_entities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (src, pivot, entity), part in batch.groupby(["src", "pivot", "entity"], sort=False):
                alphabet, pairs = plan[src]
                texts = part["unit"].unique().tolist()
                found: dict[tuple[int, ...], float] = {}
                index = {x: i for i, x in enumerate(alphabet[: pivot + 1])}
                for seqs in _sequences(texts, np.ones(len(texts)), index, alphabet[pivot], shortest):
                    _count(seqs, pairs[: pivot + 1, : pivot + 1], pivot, lengths, found)
                if found:
                    yield pd.DataFrame({"src": src, "entity": entity, "pattern": ["".join(alphabet[i] for i in p) for p in found]})

    routed, large_routed = (reduce(DataFrame.unionByName, some) for some in (parts, large_parts))
    held = _spread(large_routed.drop("salt"), "src", "pivot", "entity").mapInPandas(of_entities, "src string, entity string, pattern string")
    heavy = held.distinct().groupBy("src", "pattern").agg(F.count("*").alias("n"))
    mined = routed.repartition("src", "pivot", "salt").sortWithinPartitions("src", "pivot").select("src", "pivot", "unit", "w").mapInPandas(mine, "src string, pattern string, n long")
    enough = F.element_at(F.create_map(*(x for src, n in need.items() for x in (F.lit(src), F.lit(n)))), F.col("src"))
    name = F.create_map(*(x for i, letter in enumerate(LETTERS) for x in (F.lit(letter), F.lit(f"E{i + 1}"))))
    return (
        mined.unionByName(heavy)
        .groupBy("src", "pattern")
        .agg(F.sum("n").alias("support"))
        .where(F.col("support") >= enough)
        .select("src", F.array_join(F.transform(F.split("pattern", ""), lambda x: F.element_at(name, x)), ">").alias("pattern"), "support")
    )


def _spread(df: DataFrame, *key: str) -> DataFrame:
    """Rows over all tasks by a hash of the whole row, equal keys together within a task."""
    return df.repartition(*df.columns).sortWithinPartitions(*key)


def _entity_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The ordered pairs that the sequences of each entity hold, once for each batch."""
    index = {x: i for i, x in enumerate(LETTERS)}
    n = len(LETTERS)
    for batch in batches:
        for (src, entity), part in batch.groupby(["src", "entity"], sort=False):
            held = np.zeros((n, n), bool)
            texts = part["unit"].unique().tolist()
            for seqs in _sequences(texts, np.ones(len(texts)), index, None, 2):
                base, first = np.arange(len(seqs.after), dtype=np.int64) * seqs.after.shape[1], seqs.after[:, 0]
                for item in range(n):
                    if len(keep := np.flatnonzero(first[:, item])):
                        held[item] |= seqs.held(base[keep], first[keep, item].astype(np.int64))[1] > 0
            a, b = np.nonzero(held)
            yield pd.DataFrame({"src": src, "entity": entity, "a": a.astype(np.int32), "b": b.astype(np.int32)})
