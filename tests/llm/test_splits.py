import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import splits as S
from loomtrace.llm.queries import QUERIES
from loomtrace.llm.sequences import block_key

DATA = "/root/testdata/sf0.001"
SCHEMA = "row_id long, block_id string, trace_signature string, label boolean, node string"
SHARES = [("test", 0.15), ("train", 0.7), ("validation", 0.15)]


def groups(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for row_id, *keys in rows:
        find(row_id)
        for i, key in enumerate(keys):
            if key is not None:
                parent[find((i, key))] = find(row_id)
    out = defaultdict(list)
    for row_id, *_ in rows:
        out[find(row_id)].append(row_id)
    return list(out.values())


def pairs(found):
    return {(min(g), x) for g in found for x in g if x != min(g)}


def sig(i):
    return f"{i:064x}"


def test_signature_and_block_spellings(spark):
    texts = [sig(10), sig(10).upper(), f"sha256:{sig(10)}", f" {sig(10)}\n", "a" + sig(10)[1:], "abc", None, "", f"sha256{sig(10)}"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i long, t string").orderBy("i").select(F.lower(F.hex(S.signature_key(F.col("t"))))).collect()]
    assert got == [sig(10)] * 4 + ["a" + sig(10)[1:], None, None, None, sig(10)]
    blocks = [r[0] for r in spark.createDataFrame([(" BLK_1\t",), ("",), (None,)], "b string").select(block_key(F.col("b"))).collect()]
    assert blocks == ["blk_1", None, None]


@pytest.mark.parametrize("seed", range(3))
def test_pairs_agree_with_union_find(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, *map(str, range(60))]), rng.choice([None, *map(sig, range(70))]), None, "x") for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in S.related_pairs(df, "row_id", S.signature_key(F.col("trace_signature")), block_key(F.col("block_id"))).collect()]
    assert len(got) == len({*got}) and {*got} == pairs(groups([r[:3] for r in rows]))


def test_a_long_chain_and_a_hot_signature(spark):
    chain = [(i, str(i // 2), sig((i + 1) // 2), None, "x") for i in range(200)]
    hot = [(1000 + i, f"h{i}", sig(9999), None, "x") for i in range(150)]
    df = spark.createDataFrame(chain + hot, SCHEMA)
    got = {tuple(r) for r in S.related_pairs(df, "row_id", S.signature_key(F.col("trace_signature")), block_key(F.col("block_id"))).collect()}
    assert got == {(0, i) for i in range(1, 200)} | {(1000, 1000 + i) for i in range(1, 150)}


def test_other_keys_and_no_rows(spark):
    rows = [(1, "a", None, None, "n"), (2, None, sig(1), None, "n"), (3, "a", sig(2), None, None), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    keys = (S.signature_key(F.col("trace_signature")), block_key(F.col("block_id")), F.col("node"))
    assert {tuple(r) for r in S.related_pairs(df, "row_id", *keys).collect()} == {(1, 2), (1, 3)}
    empty = df.limit(0)
    assert S.related_pairs(empty, "row_id", *keys).count() == 0
    assert S.grouped_splits(empty, "row_id", F.col("label"), SHARES, *keys[:2]).count() == 0
    assert S.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_splits_keep_groups_shares_and_labels(spark):
    rows = QUERIES["p4_splits"](spark, DATA).collect()
    table = {r["row_id"]: r for r in spark.read.parquet(f"{DATA}/block_sequences.parquet").collect()}
    split = {r["row_id"]: r["split"] for r in rows}
    assert len(rows) == len(split) == len(table)
    for a, b in QUERIES["p4_found"](spark, DATA).collect():
        assert split[a] == split[b]
    for name, share in SHARES:
        own = [i for i, s in split.items() if s == name]
        assert abs(len(own) / len(split) - share) < 0.02
        assert {"normal", "anomaly"} <= {(table[i]["label"] or "").strip().lower() for i in own}


def test_members_of_a_bundle_are_ranked_exactly(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGES", 16)
    rows = [(i, f"b{i}", sig(i), i % 10 == 0, "x") for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    keys = (S.signature_key(F.col("trace_signature")), block_key(F.col("block_id")))
    got = S.grouped_splits(df, "row_id", F.col("label"), SHARES, *keys)
    counts = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert counts == {"test": 300, "train": 1400, "validation": 300}
    again = S.grouped_splits(df.repartition(7).orderBy(F.desc("row_id")), "row_id", F.col("label"), SHARES, *keys)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in again.collect()}


def test_split_report(spark):
    rows = [("test", "a", True), ("test", "a", False), ("train", "b", True), ("train", "c", None), ("test", "c", None)]
    report = {r["split"]: r for r in S.split_report(spark.createDataFrame(rows, "split string, root string, y boolean"), "y", SHARES).collect()}
    assert {k: (r["records"], r["yes"], r["no"], r["groups"], r["crossing"]) for k, r in report.items()} == {"test": (3, 1, 1, 2, 1), "train": (2, 1, 0, 2, 1), "validation": (0, 0, 0, 0, 0)}
    assert report["test"]["share"] == 0.6 and report["train"]["target"] == 0.7


@pytest.mark.parametrize("seed", range(4))
def test_no_move_or_exchange_lowers_the_cost(seed):
    rng = np.random.default_rng(seed)
    bundles = np.unique(np.concatenate([rng.integers(0, 6, (20, 3)), rng.integers(0, 200, (5, 3)), [[1, 0, 0], [0, 1, 0]]]), axis=0)
    bundles = bundles[bundles.sum(1) > 0]
    counts, share = rng.integers(1, 40, len(bundles)), np.array([0.15, 0.7, 0.15])
    counts[bundles.sum(1) > 20] = 1
    flow = S.allocate(bundles, counts, share)
    assert (flow.sum(1) == counts).all() and (flow >= 0).all()
    size = np.c_[bundles.sum(1), bundles] / np.maximum((np.c_[bundles.sum(1), bundles] * counts[:, None]).sum(0), 1)
    whole = size.T @ counts
    cost = lambda f: (((f.T @ size - share[:, None] * whole) ** 2).sum(1) / share).sum()
    now = cost(flow)
    for _ in range(3000):
        other = flow.copy()
        i, j = rng.integers(0, len(bundles), 2)
        a, b = rng.choice(3, 2, replace=False)
        other[i, a] -= 1
        other[i, b] += 1
        if rng.random() < 0.7:
            other[j, b] -= 1
            other[j, a] += 1
        if (other >= 0).all():
            assert cost(other) >= now - 1e-9


def test_allocation():
    bundles = np.array([[300, 0, 0], [5, 5, 0], [1, 0, 0], [0, 1, 0]])
    counts = np.array([1, 7, 500, 60])
    flow = S.allocate(bundles, counts, [0.15, 0.7, 0.15])
    assert (flow.sum(1) == counts).all() and (flow >= 0).all()
    rows = flow.T @ bundles.sum(1)
    assert np.abs(rows / rows.sum() - [0.15, 0.7, 0.15]).max() < 0.01 and (flow.T @ bundles[:, 1] > 0).all()
