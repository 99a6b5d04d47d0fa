"""The most similar vectors of every vector.

Vectors are spread over shards by their nearest centre, and each shard gets a robust-pruned directed graph (see
`graph`). A vector is a node of its home shard's graph and is looked up, by beam search, there, in the shard of the
next nearest centre, and in every shard whose centre's cosine is less than the home's by at most a margin. The margin is
measured: ``TRIALS`` vectors are compared with all others, and it is as wide as it takes to ask the homes of the share
``FOUND`` of their true neighbours. So the shards asked follow the data and the number of shards, without a limit. The
lists of all shards a vector was looked up in are merged.

Shards grow with the square root of the table, so that both a shard's size and the number of shards grow slowly. The
centres come from k-means over a bounded sample (``SAMPLE_A_CENTRE`` vectors for each centre, at most
``LARGEST_SAMPLE``), chosen by a hash of the id; every vector is indexed and looked up. A centre whose shard would be
much larger than intended is replaced by several, from k-means over its part of the sample. If more vectors are looked
up in a shard than ``LOOKUPS``, they are spread over several tasks that each hold the shard. Vectors of the same
direction are one node that knows the smallest ids of its copies, which is all that the lists can show; batches combine
their copies before anything is shuffled. Lookups away from home carry their vector in 16 bits a component, which moves
a cosine by about 1e-5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.llm.graph import Graph
from loomtrace.session import shared_checkpoint

#: Vectors of a shard, as intended, for a table of so many rows; it grows with the square root of the rows beyond them.
SHARD, ROWS = 5000, 200_000
#: Shards that a vector is looked up in at least; vectors whose true neighbours are found out, and the share of these
#: whose homes are to be asked.
PROBES, TRIALS, FOUND = 2, 256, 0.96
#: A shard this many times as large as intended is divided.
UNEVEN = 2.0
#: Routed rows of one Arrow batch.
ROUTED_ROWS = 32_768
#: Width of the beam search.
WIDTH = 8
#: Sampled vectors for each centre and in all, and lookups of one task.
SAMPLE_A_CENTRE, LARGEST_SAMPLE, LOOKUPS = 400, 200_000, 400_000
#: Directions that agree in this many decimals of every component are the same.
DECIMALS = 4
#: What a component of 1 is on the way to other shards.
SCALE = 32_000

_ROUTED = "leaf int, chunk int, home boolean, asked boolean, key binary, ids array<long>, vec binary"


def unit_rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a list column and their unit vectors; the others have a wrong number of values,
    a value that is null or not finite, or only zeros."""
    right = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False))
    values = column.take(pa.array(right)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    largest = np.abs(values).max(1, initial=0)
    good = np.isfinite(values).all(1) & (largest > 0)
    values = values[good] / largest[good, None]
    return right[good], (values / np.linalg.norm(values, axis=1, keepdims=True)).astype(np.float32)


def means(vectors: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means: up to ``count`` centres of unit rows."""
    rng = np.random.default_rng(7)
    centres = vectors[rng.choice(len(vectors), min(count, len(vectors)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        own = _nearest(vectors, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(vectors[i : i + 8192] @ centres.T).argmax(1) for i in range(0, len(vectors), 8192)])


def _centres(vectors: np.ndarray, count: int) -> np.ndarray:
    """About ``count`` centres of the distinct ``vectors``, none with more than `UNEVEN` times its share of them."""
    centres, most = means(vectors, count), UNEVEN * len(vectors) / count
    while True:
        own = _nearest(vectors, centres)
        sizes = np.bincount(own, minlength=len(centres))
        large = np.flatnonzero((sizes > most) & (sizes > 1))
        if not len(large):
            return centres
        divided = [means(vectors[own == c], math.ceil(sizes[c] * count / len(vectors))) for c in large]
        centres = np.unique(np.concatenate([np.delete(centres, large, axis=0), *divided]), axis=0)
        if len(centres) <= len(sizes):  # no further division
            return centres


_ODD = np.random.default_rng(11).integers(0, 2**64, (4096, 2), np.uint64) | np.uint64(1)


def _same(vectors: np.ndarray) -> np.ndarray:
    """A name of 16 bytes for each direction: two random linear functions, modulo 2 ** 64, of its rounded components.
    Directions that differ share a name by chance only, once in 2 ** 128 pairs."""
    rounded = np.rint(vectors * np.float32(10**DECIMALS)).astype(np.int64).view(np.uint64)
    name = np.empty((len(vectors), 2), np.uint64)
    for i in range(2):
        name[:, i] = (rounded * np.resize(_ODD[:, i], vectors.shape[1])).sum(1, dtype=np.uint64)
    return name.view("S16").ravel()


def _binary(names: np.ndarray, width: int) -> pa.Array:
    """Values of one width as a binary column, without a Python object for each."""
    data = np.ascontiguousarray(names)
    return pa.Array.from_buffers(pa.binary(width), len(names), [None, pa.py_buffer(data)]).cast(pa.binary())


def _joined(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column without nulls, one behind the other."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)


def true_neighbours(columns: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int, centres: np.ndarray | None = None) -> DataFrame:
    """``trial`` INT (a place in ``ids``), ``found`` ARRAY<STRUCT<far, id, leaf>>: the ``k`` vectors of ``columns`` (``id``,
    ``vector``) that are most similar to each of the given ones, from a comparison with all, and the nearest centre of
    each. A task keeps its ``k`` best of every given vector, of which there must be a bounded number."""
    dims = vectors.shape[1]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(ids), k), -2, np.float32)
        who, leaf = np.full((len(ids), k), -1, np.int64), np.zeros((len(ids), k), np.int32)
        for batch in batches:
            good, others = unit_rows(batch.column(1), dims)
            others_ids = batch.column(0).to_numpy(zero_copy_only=False)[good]
            homes = _nearest(others, centres).astype(np.int32) if centres is not None and len(others) else np.zeros(len(others), np.int32)
            sims = vectors @ others.T
            sims[ids[:, None] == others_ids[None, :]] = -2
            at = np.flatnonzero(sims > best.min(1)[:, None])
            row, column = np.divmod(at, max(1, len(others)))
            for t in np.unique(row).tolist():
                mine = column[row == t]
                every = np.r_[best[t], sims[t, mine]]
                top = np.argsort(-every, kind="stable")[:k]
                best[t], who[t], leaf[t] = every[top], np.r_[who[t], others_ids[mine]][top], np.r_[leaf[t], homes[mine]][top]
        row, column = np.nonzero(who >= 0)
        made = [pa.array(row, pa.int32()), pa.array(-best[row, column]), pa.array(who[row, column]), pa.array(leaf[row, column])]
        yield pa.RecordBatch.from_arrays(made, names=["trial", "far", "id", "leaf"])

    near = columns.mapInArrow(compare, "trial int, far float, id long, leaf int")
    return near.groupBy("trial").agg(F.slice(F.sort_array(F.collect_list(F.struct("far", "id", "leaf"))), 1, k).alias("found"))


def _margin(columns: DataFrame, ids: np.ndarray, vectors: np.ndarray, centres: np.ndarray, probes: int, k: int) -> float:
    """How much less than the home's the cosine of a centre may be, so that the homes of the share `FOUND` of the true
    neighbours of the given vectors are asked."""
    sims = vectors @ centres.T
    home, last = sims.max(1), np.partition(sims, len(centres) - probes, axis=1)[:, len(centres) - probes]
    gaps = []
    for r in true_neighbours(columns, ids, vectors, k, centres).collect():  # `TRIALS` rows at most
        t = r["trial"]
        gaps += [0.0 if sims[t, x["leaf"]] >= last[t] else float(home[t] - sims[t, x["leaf"]]) for x in r["found"]]
    return sorted(gaps)[math.ceil(FOUND * len(gaps)) - 1] + 1e-6 if gaps else 0.0


def nearest_vectors(df: DataFrame, key: str = "vec_id", vector: str = "vector", dims: int = 64, k: int = 5, shard: int | None = None, probes: int = PROBES, width: int = WIDTH, margin: float | None = None) -> DataFrame:
    """``id``, ``neighbour`` BIGINT, ``cosine`` DOUBLE, ``place`` INT from 1: the ``k`` vectors most similar to each.

    Usable vectors have ``dims`` finite values, not all zero; others are neither looked up nor found. ``key`` is a
    unique BIGINT. The vector itself is left out; equal cosines come in the order of ids. Vectors of the same direction
    are each other's nearest, by id. The search is approximate: a neighbour can be missed, and the cosines of those that
    come out may be off by about 1e-5. An empty table, or one without usable vectors, gives no row."""
    columns = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    rows = columns.count()
    shard = shard or math.ceil(SHARD * max(1.0, rows / ROWS) ** 0.5)
    wanted = max(1, math.ceil(rows / shard))
    sampled = min(LARGEST_SAMPLE, wanted * SAMPLE_A_CENTRE)
    part = columns.where(F.pmod(F.xxhash64("id"), F.lit(max(1, rows // sampled))) == 0) if rows > sampled else columns
    taken = part.toArrow().combine_chunks() if rows else None
    places, sample = unit_rows(taken.column(1).combine_chunks(), dims) if rows else ((), np.zeros((0, dims), np.float32))
    if not len(sample):  # no usable vector among them: one shard
        places, sample = np.zeros(0, np.int64), np.eye(1, dims, dtype=np.float32)
    _, one_each = np.unique(_same(sample), return_index=True)
    centres = _centres(sample[one_each], wanted)
    probes = min(probes, len(centres))
    if margin is None:
        trial = np.unique(np.linspace(0, len(sample) - 1, TRIALS).astype(np.int64))
        margin = _margin(columns, taken.column(0).to_numpy()[places][trial], sample[trial], centres, probes, k) if len(places) and len(centres) > probes else 0.0

    def asked_shards(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The home of each vector, and which shards it is looked up in."""
        sims = vectors @ centres.T
        home = sims.argmax(1)
        asked = sims >= np.take_along_axis(sims, home[:, None], 1) - np.float32(margin)
        np.put_along_axis(asked, np.argpartition(-sims, probes - 1, axis=1)[:, :probes], True, 1)
        return home, asked

    lookups = np.zeros(len(centres))
    for at in range(0, len(one_each), 8192):
        lookups += asked_shards(sample[one_each[at : at + 8192]])[1].sum(0)
    chunks = np.ceil(np.maximum(lookups * rows / len(sample), 1) / LOOKUPS).astype(np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, vectors = unit_rows(batch.column(1), dims)
            if not len(good):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)[good]
            order = np.argsort(ids, kind="stable")
            names, first, of = np.unique(_same(vectors[order]), return_index=True, return_inverse=True)
            # the smallest ids of each direction; ids come in ascending order
            by_node = np.argsort(of, kind="stable")
            slot = np.arange(len(of)) - np.searchsorted(of[by_node], of[by_node])
            few = by_node[slot <= k]
            offsets = np.r_[0, np.cumsum(np.bincount(of[few], minlength=len(names)))].astype(np.int32)
            copies = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[order][few]))
            vectors = vectors[order][first]
            short = np.rint(vectors * np.float32(SCALE)).astype(np.int16)
            homes, asked = asked_shards(vectors)
            node, leaf = np.nonzero(asked)
            spread = names.view(np.uint64)[::2][node] >> np.uint64(20)
            chunk = (spread % chunks[leaf].astype(np.uint64)).astype(np.int32)
            away = leaf != homes[node]
            # a node goes to all tasks of its home, which all build the graph; one of them looks it up
            at_home = np.flatnonzero(~away)
            times = chunks[leaf[at_home]]
            held = np.repeat(at_home, times)
            own_chunk = (np.arange(len(held)) - np.repeat(np.cumsum(times) - times, times)).astype(np.int32)
            for lines, home, to, look in ((held, True, own_chunk, own_chunk == chunk[held]), (np.flatnonzero(away), False, chunk[away], np.ones(away.sum(), bool))):
                for start in range(0, len(lines), ROUTED_ROWS):
                    some = slice(start, start + ROUTED_ROWS)
                    nodes = node[lines[some]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(leaf[lines[some]], pa.int32()),
                            pa.array(to[some]),
                            pa.array(np.full(len(nodes), home)),
                            pa.array(look[some]),
                            _binary(names[nodes], 16),
                            copies.take(pa.array(nodes, pa.int32())) if home else pa.nulls(len(nodes), pa.list_(pa.int64())),
                            _binary(vectors[nodes], 4 * dims) if home else _binary(short[nodes], 2 * dims),
                        ],
                        names=[x.split()[0] for x in _ROUTED.split(", ")],
                    )

    def look_up(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        names = _joined(table["key"].combine_chunks()).view("S16")
        at_home, is_asked = (table[c].to_numpy(zero_copy_only=False) for c in ("home", "asked"))
        home, asked = np.flatnonzero(at_home), np.flatnonzero(is_asked)
        vectors = np.empty((len(names), dims), np.float32)
        column = table["vec"].combine_chunks()
        vectors[at_home] = _joined(column.filter(pa.array(at_home))).view(np.float32).reshape(-1, dims)
        vectors[~at_home] = _joined(column.filter(pa.array(~at_home))).view(np.int16).reshape(-1, dims) / np.float32(SCALE)
        copies = table["ids"].combine_chunks().take(pa.array(home))
        sizes = pc.list_value_length(copies).to_numpy(zero_copy_only=False)
        node_names, at, node_of_row = np.unique(names[home], return_index=True, return_inverse=True)
        # the ids of each node's copies, ascending, padded by -1
        order = np.lexsort((copies.flatten().to_numpy(zero_copy_only=False), np.repeat(node_of_row, sizes)))
        flat = copies.flatten().to_numpy(zero_copy_only=False)[order]
        node = np.repeat(node_of_row, sizes)[order]
        slot = np.arange(len(node)) - np.searchsorted(node, node)
        members = np.full((len(at), k + 1), -1, np.int64)
        few = slot <= k
        members[node[few], slot[few]] = flat[few]
        asked_names, first = np.unique(names[asked], return_index=True)
        own = np.searchsorted(node_names, asked_names)
        own = np.where((own < len(at)) & (node_names[np.minimum(own, max(len(at) - 1, 0))] == asked_names), own, -1) if len(at) else np.full(len(first), -1)
        found = np.full((len(first), k + 1), -1, np.int64)
        sims = np.zeros((len(first), k + 1), np.float32)
        if len(at) and len(first):
            graph = Graph(vectors[home[at]])
            for here in (True, False):
                group = np.flatnonzero((own >= 0) == here)
                if len(group):
                    nodes, near = graph.search(vectors[asked[first[group]]], max(width, k + 1), own[group] if here else None)
                    found[group], sims[group] = nodes[:, : k + 1], near[:, : k + 1]
        ids = members[np.maximum(found, 0)] if len(at) else np.full((*found.shape, k + 1), -1)
        shown = (ids >= 0) & ((found >= 0) & (found != own[:, None]))[:, :, None]
        offsets = pa.array(np.r_[0, np.cumsum(shown.sum((1, 2)))].astype(np.int32))
        mine = members[np.maximum(own, 0)] if len(at) else np.full((len(first), k + 1), -1)
        mine[own < 0] = -1
        mine_offsets = pa.array(np.r_[0, np.cumsum((mine >= 0).sum(1))].astype(np.int32))
        return pa.table(
            {
                "key": _binary(asked_names, 16),
                "ids": pa.ListArray.from_arrays(offsets, pa.array(ids[shown])),
                "sims": pa.ListArray.from_arrays(offsets, pa.array(np.broadcast_to(sims[:, :, None], ids.shape)[shown])),
                "own": pa.ListArray.from_arrays(mine_offsets, pa.array(mine[mine >= 0])),
            }
        )

    routed = columns.mapInArrow(route, _ROUTED).repartition(min(int(chunks.sum()), 10_000), "leaf", "chunk")
    lists = routed.groupBy("leaf", "chunk").applyInArrow(look_up, "key binary, ids array<long>, sims array<float>, own array<long>")
    pairs = F.flatten(F.collect_list(F.transform("ids", lambda i, n: F.struct((-F.get("sims", n)).alias("far"), i.alias("i")))))
    merged = lists.groupBy("key").agg(F.sort_array(pairs).alias("others"), F.flatten(F.collect_list("own")).alias("own"))
    # a node's copies come first, then the others; copies beyond the first k + 1 have the first k
    of_member = F.transform(
        "own",
        lambda i: F.struct(
            i.alias("id"),
            F.slice(
                F.concat(F.transform(F.filter("own", lambda j: j != i), lambda j: F.struct(F.lit(-1.0).cast("float").alias("far"), j.alias("i"))), F.col("others")), 1, k
            ).alias("list"),
        ),
    )
    listed = merged.select(F.inline(of_member)).select("id", F.posexplode("list").alias("n", "x")).select("id", F.col("x.i").alias("neighbour"), (-F.col("x.far")).cast("double").alias("cosine"), (F.col("n") + 1).alias("place"))

    def copies_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, vectors = unit_rows(batch.column(1), dims)
            yield pa.RecordBatch.from_arrays([_binary(_same(vectors), 16), batch.column(0).take(pa.array(good))], names=["key", "id"])

    named = columns.mapInArrow(copies_of, "key binary, id long")
    crowded = shared_checkpoint(named.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("key"))
    if crowded.isEmpty():
        return listed
    copies = named.join(crowded, "key")
    first = copies.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("rank") <= k + 1)
    firsts = first.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("first"))
    more = (
        copies.join(firsts, "key")
        .where(~F.array_contains("first", F.col("id")))
        .select("id", F.posexplode(F.slice("first", 1, k)).alias("n", "neighbour"))
        .select("id", "neighbour", F.lit(1.0).alias("cosine"), (F.col("n") + 1).alias("place"))
    )
    return listed.unionByName(more)


def measured_recall(df: DataFrame, key: str = "vec_id", vector: str = "vector", dims: int = 64, k: int = 5, trials: int = 1000, **settings: float) -> DataFrame:
    """``trials``, ``neighbours`` BIGINT, ``recall`` DOUBLE: which share of the ``k`` most similar vectors `nearest_vectors`
    finds. About ``trials`` vectors, chosen by a hash of the id, are compared with all others. A vector it finds counts
    if it is as similar as the true ``k``-th. Without usable vectors the counts are 0 and the share null."""
    columns = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    each = max(1, columns.count() // trials)
    taken = columns.where(F.pmod(F.xxhash64("id", F.lit("trial")), F.lit(each)) == 0).toArrow().combine_chunks()
    places, vectors = unit_rows(taken.column(1).combine_chunks(), dims) if len(taken) else (np.zeros(0, np.int64), np.zeros((0, dims), np.float32))
    ids = taken.column(0).to_numpy()[places] if len(taken) else np.zeros(0, np.int64)
    true = true_neighbours(columns, ids, vectors, k)
    names = df.sparkSession.createDataFrame(list(enumerate(ids.tolist())), "trial int, id long")
    wanted = true.join(names, "trial").select("id", F.size("found").alias("n"), (-F.element_at("found", -1)["far"] - 5e-5).alias("least"))
    found = nearest_vectors(df, key, vector, dims, k, **settings)
    hits = wanted.join(found, "id", "left").groupBy("id").agg(F.first("n").alias("n"), F.count_if(F.col("cosine") >= F.col("least")).alias("hits"))
    counted = hits.agg(F.count("*").alias("trials"), F.coalesce(F.sum("n"), F.lit(0)).alias("neighbours"), F.sum("hits").alias("hits"))
    return counted.select("trials", "neighbours", F.try_divide(F.col("hits").cast("double"), "neighbours").alias("recall"))
