"""Scoring of a set of queries against a knowledge base, in blocks, and selection of contexts.

The queries go to the tasks in blocks of at most ``MOST_QUERIES``; the knowledge base stays where it is and is read
once for each block. Each task keeps only the best candidates of its part for each query, so what is shuffled is the
number of tasks times queries times k, whatever the knowledge base's size."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions.sequences import event_bits, gram_bucket, jaccard_bits, ngrams
from loomtrace.functions.vectors import unit, vector_key
from loomtrace.session import shared_checkpoint

#: Queries of a block, and scores that a task computes at once.
MOST_QUERIES, SCORES = 20_000, 4_000_000
#: Scores are ranked after rounding, so that equal scores tie whatever the order of summation.
DECIMALS = 9
#: Queries that stand in one row while all pairs are made.
PAIRED = 1_000


def lcs_matrix(queries: Sequence[Sequence], candidates: Sequence[Sequence]) -> np.ndarray:
    """Longest common subsequence over the longer length of every query with every candidate; 1 for two empty sequences.

    One query goes against all candidates at once: place i of the query is bit i of a candidate's row of 64-bit words, and
    each event of the candidates is one addition with carry over the words (Hyyrö, 2004). Candidates stand by falling
    length, so that a step touches those only that have so many events."""
    places: dict = {}
    coded = [np.fromiter((places.setdefault(e, len(places)) for e in c), np.int64, len(c)) for c in candidates]
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    longest = int(sizes[0]) if len(sizes) else 0
    grid = np.full((longest, len(order)), len(places), np.int64)  # by step, so that a step's events lie together
    for column, i in enumerate(order):
        grid[: lengths[i], column] = coded[i]
    active = [int(np.searchsorted(-sizes, -step)) for step in range(longest)]  # candidates longer than the step
    out = np.empty((len(queries), len(order)))
    for q, query in enumerate(queries):
        n = len(query)
        words = max(1, -(-n // 64))
        masks = np.zeros((words, len(places) + 1), np.uint64)
        for i, event in enumerate(query):
            if event in places:
                masks[i // 64, places[event]] |= np.uint64(1 << (i % 64))
        rows = np.full((words, len(order)), ~np.uint64(0))
        for step, count in enumerate(active):
            events, carry = grid[step, :count], None
            for w in range(words):
                row = rows[w, :count]
                matched = row & masks[w].take(events)
                total = row + matched
                over = total < row
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64) if w + 1 < words else None
                np.bitwise_or(total, row & ~matched, out=row)
        if n % 64:
            rows[-1] |= ~np.uint64((1 << (n % 64)) - 1)
        common = 64 * words - np.bitwise_count(rows).sum(0, dtype=np.int64)
        longer = np.maximum(sizes, n)
        out[q, order] = np.where(longer > 0, common / np.maximum(longer, 1), 1.0)
    return out


def jaccard_scores(queries: Sequence[Sequence], candidates: Sequence[Sequence]) -> np.ndarray:
    """Share of common distinct events of every query with every candidate, from incidence matrices; 1 for two empty
    sequences."""
    places: dict = {}
    sides = []
    for sequences in (queries, candidates):
        sides.append([[places.setdefault(e, len(places)) for e in {*s}] for s in sequences])
    held = [np.zeros((len(side), len(places)), np.float32) for side in sides]
    for matrix, side in zip(held, sides):
        for row, events in zip(matrix, side):
            row[events] = 1
    common = held[0] @ held[1].T
    either = held[0].sum(1)[:, None] + held[1].sum(1)[None, :] - common
    return np.where(either > 0, common.astype(float) / np.maximum(either, 1), 1.0)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    vectors = np.asarray(vectors, float)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def block_top(queries: DataFrame, base: DataFrame, k: int, score: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], query_id: str, base_id: str, leave_out_self: bool = False) -> DataFrame:
    """``query_id``, ``base_id``, ``score``, ``rank`` from 1: the ``k`` best rows of ``base`` for each query.

    ``score`` gets some of the queries and one block of the base and returns a matrix. Any number of queries is
    answered; all are collected on the driver, which sends them out by blocks. Ids are BIGINT or STRING; ties go to the
    smaller id. ``leave_out_self`` leaves out a base row with the query's own id."""
    if MOST_QUERIES < 1:
        raise ValueError("a block holds at least one query")
    every = queries.toPandas()
    kinds = {x: (f.schema[x].dataType.simpleString()) for f, x in ((queries, query_id), (base, base_id))}
    names = (query_id, base_id) if query_id != base_id else (query_id, f"{base_id}_found")

    def answers(asked: pd.DataFrame) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: list[list[tuple]] = [[] for _ in range(len(asked))]
            ids = asked[query_id].tolist()
            for block in batches:
                if not len(block) or not len(asked):
                    continue
                own_ids = block[base_id].to_numpy()
                kept = min(k + 1, len(own_ids))
                step = max(1, SCORES // len(block))
                for start in range(0, len(asked), step):
                    scores = np.round(score(asked.iloc[start : start + step], block), DECIMALS)
                    for q, row in enumerate(scores, start):
                        # all that tie with the last kept one go on, and the ids decide
                        best_here = np.flatnonzero(row >= np.partition(row, len(row) - kept)[len(row) - kept])
                        found = [(-row[i], own_ids[i]) for i in best_here if not (leave_out_self and own_ids[i] == ids[q])]
                        best[q] = heapq.nsmallest(k, best[q] + found)
            rows = [(ids[q], i, -s) for q, found in enumerate(best) for s, i in found]
            yield pd.DataFrame(rows, columns=[*names, "score"])

        return run

    spark = base.sparkSession
    # scoring costs far more than moving a row, so even a small base is spread over all cores
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = base.repartition(parts, base_id)
    blocks = [every.iloc[at : at + MOST_QUERIES].reset_index(drop=True) for at in range(0, max(1, len(every)), MOST_QUERIES)]
    found = [spread.mapInPandas(answers(asked), f"`{names[0]}` {kinds[query_id]}, `{names[1]}` {kinds[base_id]}, score double") for asked in blocks]
    part = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(Window.partitionBy(names[0]).orderBy(F.desc("score"), names[1]))
    return part.withColumn("rank", rank).where(F.col("rank") <= k)


def jaccard_pairs(queries: DataFrame, base: DataFrame, events: str, query_id: str, base_id: str, decimals: int = 6) -> DataFrame:
    """``query_id``, ``base_id``, ``score``: the Jaccard share of distinct events of every query with every row of
    ``base``, rounded. All in column expressions.

    Sequences become bits before they are paired. Queries stand about ``PAIRED`` to a row, ordered by their events; every
    such row meets every part of the base and is opened there. Nothing is broadcast or sent to the driver, and a result
    holds few distinct queries close together, which keeps written columns small."""
    if PAIRED < 1:
        raise ValueError("a row holds at least one query")
    spark = base.sparkSession
    rows = max(1, -(-queries.count() // PAIRED))
    asked = queries.select(event_bits(F.col(events)).alias("_asked"), query_id)
    held = asked.groupBy(F.pmod(F.hash(query_id), F.lit(rows))).agg(F.array_sort(F.collect_list(F.struct("_asked", query_id))).alias("_held")).select("_held")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = base.select(base_id, event_bits(F.col(events)).alias("_bits")).repartition(parts, base_id)
    # by the hint neither side is broadcast, as a broadcast base would leave all pairs to the few tasks of the queries
    pairs = held.hint("shuffle_replicate_nl").crossJoin(spread).select(base_id, "_bits", F.inline("_held"))
    return pairs.select(query_id, base_id, jaccard_bits(F.col("_asked"), F.col("_bits"), decimals).alias("score"))


def cosine_block(query_vector: str, base_vector: str) -> Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]:
    def score(asked: pd.DataFrame, block: pd.DataFrame) -> np.ndarray:
        return np.clip(unit_rows(np.stack(asked[query_vector])) @ unit_rows(np.stack(block[base_vector])).T, -1, 1)

    return score


def structure_block(events: str, weights: tuple[float, float, float]) -> Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]:
    """Weighted sum of the cosine of `gram_cells` moved to 0..1, the Jaccard share of distinct events and the LCS share
    of the order. Parts of weight 0 are not computed."""

    def score(asked: pd.DataFrame, block: pd.DataFrame) -> np.ndarray:
        total = np.zeros((len(asked), len(block)))
        if weights[0]:
            near = np.clip(dense_rows(asked["cells"], asked["weights"]) @ dense_rows(block["cells"], block["weights"]).T, -1, 1)
            total += weights[0] * (near + 1) / 2
        sequences = [tuple(x) for x in block[events]]
        if weights[1]:
            total += weights[1] * jaccard_scores([tuple(x) for x in asked[events]], sequences)
        if weights[2]:
            total += weights[2] * lcs_matrix([tuple(x) for x in asked[events]], sequences)
        return total

    return score


def valid_weights(weights: Sequence[float]) -> bool:
    return len(weights) == 3 and all(np.isfinite(w) and w >= 0 for w in weights) and abs(sum(weights) - 1) < 1e-9


def gram_cells(df: DataFrame, events: str, buckets: int = 1024, binary: bool = False) -> DataFrame:
    """Hashed n-grams of each row as a sparse unit vector: ``cells`` ARRAY<INT>, ascending, and ``weights``
    ARRAY<DOUBLE>. ``binary`` counts a cell once. All in column expressions."""
    places = F.array_sort(F.transform(ngrams(F.col(events)), lambda g: gram_bucket(g, buckets)))
    counted = df.withColumn("_places", F.when(F.spark_partition_id() >= 0, places)).withColumn("cells", F.array_distinct("_places"))
    # in sorted places a cell's count is the way from its first place to the next cell's
    first = lambda k: F.coalesce(F.array_position("_places", F.get("cells", k)), F.size("_places") + 1)
    count = F.transform("cells", lambda _, k: F.lit(1.0) if binary else (first(k + 1) - first(k)).cast("double"))
    return counted.withColumn("weights", unit(count)).drop("_places")


def dense_rows(cells: pd.Series, weights: pd.Series, buckets: int = 1024) -> np.ndarray:
    sizes = np.fromiter(map(len, cells), np.int64, len(cells))
    dense = np.zeros((len(cells), buckets))
    if sizes.sum():
        dense[np.repeat(np.arange(len(cells)), sizes), np.concatenate(cells.to_list()).astype(np.int64)] = np.concatenate(weights.to_list())
    return dense


def knn_votes(ranked: DataFrame, query_id: str, ks: Sequence[int]) -> DataFrame:
    """Predictions for every k from one ranked list (``score`` a cosine, ``label``): neighbours vote by the inverse of
    their distance; where one is at distance 0, only such vote; Anomaly needs the larger weight."""
    at = ranked.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).where(F.col("rank") <= F.col("k"))
    distance = 1 - F.col("score")
    any_zero = F.max((distance <= 1e-7).cast("int")).over(Window.partitionBy(query_id, "k")) == 1  # k rows
    weight = F.when(any_zero, (distance <= 1e-7).cast("double")).otherwise(1 / F.greatest(distance, F.lit(1e-7)))
    summed = at.withColumn("w", weight).groupBy(query_id, "k").agg(*(F.coalesce(F.sum(F.when(F.col("label") == x, F.col("w"))), F.lit(0.0)).alias(x.lower()) for x in ("ANOMALY", "NORMAL")))
    return summed.select(query_id, "k", F.when(F.round(F.col("anomaly") - F.col("normal"), 6) > 0, "ANOMALY").otherwise("NORMAL").alias("prediction"))


def select_fixed(ranked: DataFrame, ks: Sequence[int]) -> DataFrame:
    """The contexts of every fixed k from one ranked list."""
    return ranked.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).where(F.col("rank") <= F.col("k"))


def select_adaptive(ranked: DataFrame, queries: DataFrame, query_id: str, pool: int, threshold: float | Column, base_size: int) -> DataFrame:
    """Per query the number of contexts in the pool with at least the threshold's score, possibly none, and the number of
    candidates left out of the whole base."""
    passing = ranked.where((F.col("rank") <= pool) & (F.col("score") >= threshold)).groupBy(query_id).agg(F.count("*").alias("passing_count"))
    return queries.select(query_id).join(passing, query_id, "left").na.fill(0, ["passing_count"]).withColumns({"candidate_count": F.lit(base_size).cast("long"), "filtered_out": F.lit(base_size).cast("long") - F.col("passing_count")})


def score_quantiles(ranked: DataFrame, pool: int, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Exact linear quantiles of the scores of all queries' pools."""
    made = ranked.where(F.col("rank") <= pool).agg(F.percentile("score", F.array(*(F.lit(q) for q in quantiles))).alias("q"))
    return made.select(F.posexplode("q").alias("i", "threshold")).select(F.get(F.array(*(F.lit(q) for q in quantiles)), F.col("i")).alias("quantile"), "threshold")


def vector_audit(queries: DataFrame, base: DataFrame, query_id: str, vector: str, decimals: int = 7) -> DataFrame:
    """Queries whose vector, rounded, occurs in the base: with the number of such rows of each label and the smallest
    id. An equality join on the rounded vector; queries without a match keep nulls."""
    groups = base.groupBy(vector_key(F.col(vector), decimals).alias("_key")).agg(
        F.count("*").alias("matches"), F.count_if(F.col("label") == "ANOMALY").alias("anomaly_matches"), F.count_if(F.col("label") == "NORMAL").alias("normal_matches"), F.min("base_id").alias("first_match")
    )
    keyed = queries.select(query_id, "label", vector_key(F.col(vector), decimals).alias("_key"))
    return keyed.join(groups, "_key", "left").drop("_key").withColumn("ambiguous", F.coalesce((F.col("anomaly_matches") > 0) & (F.col("normal_matches") > 0), F.lit(False)))


def overlap_audit(queries: DataFrame, base: DataFrame) -> DataFrame:
    """How far queries are known to the base: ``block_id``, ``label``, ``exact`` (whether a base row has the same vector,
    rounded), ``ambiguous`` (such rows of both labels), ``nearest`` (the smallest such ``base_id``, else that of the most
    similar row), ``score`` and ``prediction``.

    Both have ``cells`` and ``weights`` of `gram_cells` and ``label`` (Normal or Anomaly). Queries with the same vector in
    the base are answered by an equality join, by the majority of its labels, NORMAL in a tie; only the others are
    compared with the whole base."""
    key = F.to_json(F.struct("cells", F.transform("weights", lambda w: F.round(w, 7)).alias("w")))
    groups = base.groupBy(key.alias("_key")).agg(F.count_if(F.col("label") == "Anomaly").alias("a"), F.count_if(F.col("label") == "Normal").alias("n"), F.min("base_id").alias("nearest"))
    keyed = queries.withColumn("_key", key)
    said = F.when(F.col("a") > F.col("n"), "ANOMALY").otherwise("NORMAL")
    known = keyed.join(groups, "_key").select("block_id", "label", F.lit(True).alias("exact"), ((F.col("a") > 0) & (F.col("n") > 0)).alias("ambiguous"), "nearest", F.lit(1.0).alias("score"), said.alias("prediction"))
    unknown = shared_checkpoint(keyed.join(groups.select("_key"), "_key", "left_anti").drop("_key"))
    top = block_top(unknown.select("block_id", "cells", "weights"), base.select("base_id", "cells", "weights"), 1, gram_block, "block_id", "base_id")
    near = top.join(base.select("base_id", F.upper("label").alias("prediction")), "base_id").select("block_id", F.col("base_id").alias("nearest"), "score", "prediction")
    rest = unknown.select("block_id", "label").join(near, "block_id", "left").select("block_id", "label", F.lit(False).alias("exact"), F.lit(False).alias("ambiguous"), "nearest", "score", "prediction")
    return known.unionByName(rest)


def gram_block(asked: pd.DataFrame, block: pd.DataFrame) -> np.ndarray:
    """Cosines of `gram_cells`."""
    return np.clip(dense_rows(asked["cells"], asked["weights"]) @ dense_rows(block["cells"], block["weights"]).T, -1, 1)


def audit_ratios(audited: DataFrame) -> DataFrame:
    """``queries``, ``exact_share``, ``ambiguous_share``, ``accuracy`` over all, and over exact and other queries; null
    where there are none."""
    right = (F.upper("label") == F.col("prediction")).cast("double")
    return audited.agg(
        F.count("*").alias("queries"), F.avg(F.col("exact").cast("double")).alias("exact_share"), F.avg(F.col("ambiguous").cast("double")).alias("ambiguous_share"),
        F.avg(right).alias("accuracy"), F.avg(F.when(F.col("exact"), right)).alias("exact_accuracy"), F.avg(F.when(~F.col("exact"), right)).alias("other_accuracy"),
    )
