"""Splits that keep related records together.

Records belong together when they share a key value, directly or through other records. The first key makes the
nodes of a graph, and each value of another key links all nodes it occurs with; a value that occurs with one node
only, the usual case, links nothing, so the graph holds no more than the exceptions. Its components come from
alternating large and small stars (Kiveris and others, 2014), with lineage cut after each round.

Splits are then allocated by flow: components of the same size and label profile make one bundle, of which only the
counts reach the driver (204 bundles for 408,108 rows of the test tables). The proportional flow from bundles to splits
costs nothing but is not integral; its integral part is sent, the other components take the cheapest arcs, and negative
cycles of the residual network, through one or two bundles, are cancelled until there is none. Members of a bundle are
assigned by their rank in the order of a hash, which comes from counts of hash ranges, so that no window holds a whole
bundle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.operators.allocation import allocate
from loomtrace.session import shared_checkpoint

#: Ranges of the hash by which members are ranked.
RANGES = 4096


def signature_key(signature: Column) -> Column:
    """The 64 hex digits of a signature as bytes, whatever stands around them and whatever their case; null without."""
    low = F.lower(signature)
    alone = F.regexp_extract(low, "(?<![0-9a-f])([0-9a-f]{64})(?![0-9a-f])", 1)
    return F.unhex(F.nullif(F.when(alone != "", alone).otherwise(F.regexp_extract(low, "([0-9a-f]{64})(?![0-9a-f])", 1)), F.lit("")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round of large or small stars over edges ``u``, ``v``."""
    swapped = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    seen = edges.unionByName(swapped) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = seen.join(least, "u")
    if large:
        new = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return new.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` of every node of the edges ``u``, ``v``; the root is the component's least node.

    Nodes may be of any type that can be compared. Loops and repeated edges change nothing; edges with a null are
    left out; without edges the result is empty."""
    now, before = shared_checkpoint(edges.where("u <> v").select("u", "v").distinct()), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        now = shared_checkpoint(_star(_star(now, True), False))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def related_groups(df: DataFrame, row_id: str, first_key: Column, *other_keys: Column, **keep: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with the node of their first key, and the nodes with their group.

    Returns rows (``row_id``, ``node`` and the columns of ``keep``) and nodes (``node``, ``root``, ``first_id``: the smallest row_id of the whole
    group, ``n``: its rows). ``row_id`` must be unique. Rows without first key are nodes of their own, which the other
    keys may link. Null keys connect nothing."""
    own = F.concat(F.lit(b"r"), F.col(row_id).cast("string").cast("binary"))
    keyed = df.select(
        F.col(row_id).alias("row_id"),
        F.coalesce(F.concat(F.lit(b"k"), first_key.cast("binary")), own).alias("node"),
        *(key.alias(f"k{i}") for i, key in enumerate(other_keys)),
        *(value.alias(name) for name, value in keep.items()),
    )
    rows = keyed.select("row_id", "node", *keep)
    edges = None
    for i in range(len(other_keys)):
        held = keyed.where(F.col(f"k{i}").isNotNull()).select(F.col(f"k{i}").alias("key"), "node")
        linking = held.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("last")).where("v <> last").select("key", "v")
        own_edges = held.join(linking, "key").where("node <> v").select(F.col("node").alias("u"), "v")
        edges = own_edges if edges is None else edges.unionByName(own_edges)
    nodes = rows.groupBy("node").agg(F.min("row_id").alias("first_id"), F.count("*").alias("n"))
    rooted = nodes.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node")) if edges is not None else nodes.withColumn("root", F.col("node"))
    groups = rooted.groupBy("root").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"))
    return rows, rooted.select("node", "root").join(groups, "root")


def related_pairs(df: DataFrame, row_id: str, first_key: Column, *other_keys: Column) -> DataFrame:
    """``row_id_a``, ``row_id_b``: the smallest row of each group of two or more, with each other row of the group.

    Rows with null row_id are left out. A row_id that is repeated gives a pair for each of its rows but those of the
    smallest."""
    rows, nodes = related_groups(df.where(F.col(row_id).isNotNull()), row_id, first_key, *other_keys)
    grouped = nodes.where("n > 1").select("node", F.col("first_id").alias("row_id_a"))
    return rows.join(grouped, "node").where("row_id <> row_id_a").select("row_id_a", F.col("row_id").alias("row_id_b"))


def grouped_splits(df: DataFrame, row_id: str, label: Column, splits: Sequence[tuple[str, float]], first_key: Column, *other_keys: Column) -> DataFrame:
    """``row_id``, ``split``, ``root`` (the group) of every row, related rows in one split, near the given shares, with
    both labels in each.

    ``label`` is a boolean column; null is a profile of its own. Groups are bundled by their number of rows of each
    label, so the driver gets one row for each profile that occurs. The result depends on the rows only, not on their
    order. An empty table gives no row."""
    rows, nodes = related_groups(df, row_id, first_key, *other_keys, label=label)
    nodes = shared_checkpoint(nodes.select("node", "root"))
    profile = rows.groupBy("node").agg(F.count_if("label").alias("yes"), F.count_if(~F.col("label")).alias("no"), F.count("*").alias("n"))
    key = ["yes", "no", "n"]
    spot = F.xxhash64("root")
    groups = shared_checkpoint(
        nodes.join(profile, "node").groupBy("root").agg(*(F.sum(c).alias(c) for c in key))
        .withColumns({"spot": spot, "range": F.pmod(F.shiftrightunsigned(spot, 40), F.lit(RANGES)).cast("int")})
    )
    ranges = groups.groupBy(*key, "range").agg(F.count("*").alias("inside"))
    found = ranges.groupBy(*key).agg(F.sum("inside").alias("groups")).collect()
    found.sort(key=lambda r: (r["n"], r["yes"], r["no"]))
    sizes = np.array([[r["yes"], r["no"], r["n"] - r["yes"] - r["no"]] for r in found], np.int64).reshape(-1, 3)
    flow = allocate(sizes, np.array([r["groups"] for r in found], np.int64), [s for _, s in splits]) if found else np.zeros((0, len(splits)), np.int64)
    allotted = df.sparkSession.createDataFrame([(*(r[c] for c in key), np.cumsum(f).tolist()) for r, f in zip(found, flow)], "yes long, no long, n long, upto array<long>")
    before = F.sum("inside").over(Window.partitionBy(*key).orderBy("range")) - F.col("inside")  # at most `RANGES` rows a bundle
    starts = ranges.withColumn("before", before).join(allotted, key).drop("inside")
    rank = F.row_number().over(Window.partitionBy(*key, "range").orderBy("spot", "root")) - 1
    placed = groups.withColumn("rank", rank).join(starts, [*key, "range"])
    names = F.array(*(F.lit(n) for n, _ in splits))
    split = F.get(names, F.size(F.filter("upto", lambda x: x <= F.col("before") + F.col("rank"))))
    assigned = placed.select("root", split.alias("split"))
    return rows.join(nodes, "node").join(assigned, "root").select("row_id", "split", "root")


def split_report(assigned: DataFrame, label: str, splits: Sequence[tuple[str, float]]) -> DataFrame:
    """What the rows ``split``, ``root`` and the boolean ``label`` of `grouped_splits` come to, one row per split:
    ``target``, ``records``, ``share``, ``yes``, ``no``, ``groups``, and ``crossing``: groups with records elsewhere too."""
    spread = assigned.groupBy("root").agg(F.count_distinct("split").alias("k"))
    counted = assigned.join(spread, "root").groupBy("split").agg(
        F.count("*").alias("records"), F.count_if(label).alias("yes"), F.count_if(~F.col(label)).alias("no"), F.count_distinct("root").alias("groups"), F.count_distinct(F.when(F.col("k") > 1, F.col("root"))).alias("crossing")
    )
    whole = sum(s for _, s in splits)
    wanted = assigned.sparkSession.createDataFrame([(n, s / whole) for n, s in splits], "split string, target double")
    total = F.sum("records").over(Window.partitionBy(F.lit(1)))  # one row per split
    made = wanted.join(counted, "split", "left").na.fill(0)
    return made.withColumn("share", F.coalesce(F.try_divide(F.col("records").cast("double"), total), F.lit(0.0)))
