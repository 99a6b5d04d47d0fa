import numpy as np
import pyarrow as pa
import pytest

from loomtrace.llm import neighbours as N
from loomtrace.llm.graph import Graph
from loomtrace.llm.queries import QUERIES

SCHEMA = "vec_id long, vector array<float>, id string"


def brute(ids, vectors, k=5):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    return {i: [ids[j] for j in np.lexsort((ids, -np.round(row, 5)))[:k]] for i, row in zip(ids, sims)}, sims


def lists(df, **kw):
    got = {}
    for r in N.nearest_vectors(df, **kw).orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    return got


def test_recall_of_the_graph():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 64))
    v = centres[rng.integers(60, size=3000)] + 0.3 * rng.normal(size=(3000, 64))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    graph = Graph(v)
    assert (graph.degree == (graph.edges < len(v)).sum(1)).all() and graph.degree.min() > 0 and graph.edges.max() == len(v)
    assert not (graph.edges == np.arange(len(v))[:, None]).any()
    sims = v @ v.T
    np.fill_diagonal(sims, -2)
    want = np.argsort(-sims, axis=1)[:, :5]
    for starts in (None, np.arange(len(v))):
        found, scores = graph.search(v, 16, starts)
        assert (np.diff(scores, axis=1) <= 1e-6).all()
        assert (found[:, :, None] == want[:, None, :]).any(1).mean() > 0.97


def test_recall_of_the_operator_on_the_test_table(spark):
    data = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["vector"]) for r in spark.read.parquet(f"{data}/trace_vectors.parquet").collect()]
    good = [(i, v) for i, v in rows if v is not None and len(v) == 64 and np.isfinite(v).all() and np.any(v)]
    ids = np.array([i for i, _ in good])
    want, sims = brute(ids, np.array([v for _, v in good]))
    got = lists(spark.read.parquet(f"{data}/trace_vectors.parquet"), shard=400)  # several shards
    assert {*got} == {*ids.tolist()} and all(len(x) == 5 for x in got.values())
    assert np.mean([len({*got[i]} & {*want[i]}) / 5 for i in ids.tolist()]) > 0.9
    at = {i: n for n, i in enumerate(ids.tolist())}
    close = {(min(a, b), max(a, b)) for a in got for b in want[a] if sims[at[a], at[b]] >= 0.9}
    found = {tuple(r) for r in QUERIES["p6_found"](spark, data).collect()}
    assert len(found & close) / len(close) > 0.97 and len(found - close) < 0.03 * len(close)


def test_recall_holds_when_shards_are_many(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/trace_vectors.parquet").select("vec_id", "vector")
    good = [(r["vec_id"], r["vector"]) for r in df.collect() if r["vector"] is not None and len(r["vector"]) == 64 and np.isfinite(r["vector"]).all() and np.any(r["vector"])]
    ids, vectors = np.array([i for i, _ in good]), np.array([v for _, v in good])
    want, _ = brute(ids, vectors)
    recall = lambda got: np.mean([len({*got[i]} & {*want[i]}) / 5 for i in ids.tolist()])
    assert recall(lists(df, shard=20)) > 0.89


def test_small_graphs():
    v = np.eye(3, 64, dtype=np.float32)
    assert Graph(v[:0]).search(v, 6)[0].tolist() == [[-1] * 6] * 3
    found, sims = Graph(v[:1]).search(v, 6)
    assert found.tolist() == [[0] + [-1] * 5] * 3 and sims[:, 0].tolist() == [1, 0, 0]
    assert {*Graph(np.repeat(v, 300, axis=0)).search(v, 6)[1].ravel().round(5).tolist()} == {1.0}  # copies


def test_centres_divide_crowded_shards():
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(200, 64)), rng.normal(size=64) * 3 + rng.normal(size=(1800, 64)) * 0.5])
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    centres = N._centres(v, 20)
    assert np.bincount(N._nearest(v, centres)).max() <= N.UNEVEN * 100
    assert len(N._centres(np.repeat(v[:1], 50, axis=0), 5)) >= 1


def test_unusable_vectors_few_vectors_and_extra_columns(spark):
    v = [1.0] + [0.0] * 63
    rows = [(1, v, "x"), (2, [2.0] + [0.0] * 63, "x"), (3, None, "x"), (4, [0.0] * 64, "x"), (5, [float("nan")] + v[1:], "x"), (6, v[:10], "x"), (7, [float("inf")] + v[1:], "x"), (8, [None] + v[1:], "x"), (9, [-1.0] + v[1:], "x")]
    assert lists(spark.createDataFrame(rows, SCHEMA)) == {1: [2, 9], 2: [1, 9], 9: [1, 2]}
    assert lists(spark.createDataFrame(rows, SCHEMA).limit(0)) == {}
    assert lists(spark.createDataFrame(rows[2:5], SCHEMA)) == {}


@pytest.mark.parametrize("lookups", [400_000, 20])
def test_copies_hold_a_third_of_all_rows(spark, monkeypatch, lookups):
    monkeypatch.setattr(N, "LOOKUPS", lookups)  # few lookups a task: several tasks hold one shard
    rng = np.random.default_rng(2)
    base = rng.normal(size=64)
    rows = [(i, rng.normal(size=64).tolist(), "x") for i in range(120)] + [(1000 + i, (base * (1 + i % 3)).tolist(), "x") for i in range(60)]
    rows += [(2000 + i, (base + 0.05 * rng.normal(size=64)).tolist(), "x") for i in range(10)]
    rng.shuffle(rows)
    rows = [(int(a), [float(x) for x in b], c) for a, b, c in rows]
    got = lists(spark.createDataFrame(rows, SCHEMA).repartition(4), shard=20, probes=3)
    want, _ = brute(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
    for i in range(1000, 1060):
        assert got[i] == [x for x in range(1000, 1007) if x != i][:5]
    for i in range(2000, 2010):
        assert got[i] == want[i]
    assert len(got) == len(rows) and all(len(x) == 5 and len({*x}) == 5 for x in got.values())


def test_unit_rows():
    column = pa.array([[3.0, 4.0], None, [1.0], [0.0, 0.0], [None, 1.0], [1e30, 0.0]], pa.list_(pa.float32()))
    places, vectors = N.unit_rows(column, 2)
    assert places.tolist() == [0, 5] and np.allclose(vectors, [[0.6, 0.8], [1.0, 0.0]])


def test_measured_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/trace_vectors.parquet")
    (row,) = N.measured_recall(df, shard=60, trials=100).collect()
    assert row["trials"] >= 50 and row["neighbours"] == 5 * row["trials"] and row["recall"] > 0.9
    (none,) = N.measured_recall(df.limit(0)).collect()
    assert tuple(none) == (0, 0, None)
