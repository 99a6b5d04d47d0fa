import random
from collections import Counter, defaultdict
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from loomtrace.llm import patterns as P
from loomtrace.llm.queries import QUERIES
from loomtrace.llm.runs import collapse_event_rows, collapse_runs
from loomtrace.llm.sequences import both_sources

DATA = "/root/testdata/sf0.001"


def plain_runs(events):
    at, out = 0, []
    for key, group in groupby(events):
        n = len(list(group))
        out.append((at, at + n - 1, key, n))
        at += n
    return out


def test_runs_of_the_test_tables(spark):
    rows = both_sources(spark, DATA).collect()
    want = {(r["src"], r["row_id"], a, b) for r in rows if r["events"] for a, b, _, n in plain_runs(r["events"]) if n > 1}
    assert {tuple(r) for r in QUERIES["p1_found"](spark, DATA).collect()} == want and want


def test_runs_with_nulls_gaps_and_clashing_columns(spark):
    rows = [
        (1, ["a", "a", None, None, "b", "b", "b"], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], "x"), (2, [], [], "x"), (3, None, None, None), (4, ["a"], [], "x"), (5, ["a", "a"], None, "x"), (6, ["a", "a"], [None], "x"), (7, ["a", "a"], [], "x"),
        (1, ["a", "a"], [0.5], "repeated"),
    ]
    df = spark.createDataFrame(rows, "id long, e array<string>, g array<double>, duration string")
    got = Counter((r["id"], r["first_pos"], r["last_pos"], r["event"], r["n_events"], r["duration"]) for r in collapse_runs(df, "e", "g").collect())
    assert got == Counter([
        (1, 0, 1, "a", 2, 1.0), (1, 2, 2, None, 1, 0.0), (1, 3, 3, None, 1, 0.0), (1, 4, 6, "b", 3, 11.0), (4, 0, 0, "a", 1, 0.0), (5, 0, 1, "a", 2, None), (6, 0, 1, "a", 2, None), (7, 0, 1, "a", 2, None), (1, 0, 1, "a", 2, 0.5),
    ])
    assert collapse_runs(df, "e", at_least=2).count() == 6 and collapse_runs(df.limit(0), "e", "g").count() == 0


def test_a_long_sequence(spark):
    n = 300_000
    df = spark.range(1).select("id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i / 3).cast("int")).alias("e"))
    r = collapse_runs(df, "e").agg(F.count("*"), F.min("n_events"), F.max("last_pos")).first()
    assert tuple(r) == (n // 3, 3, n - 1)


@pytest.mark.parametrize("parts", [1, 7])
def test_runs_of_event_rows_over_many_parts(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot", "hot", *"abcdef"]), rng.choice([None, *range(400)]), rng.choice(["x", "x", "x", "y", None]), i) for i in range(900)]
    rows += [("one", i, "z", i) for i in range(300)] + [(None, 1, "x", 1)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame([(*r, "extra") for r in rows], "who string, at int, what string, n int, entity string").repartition(3)
        got = Counter(tuple(r) for r in collapse_event_rows(df, "who", "at", "what", "n").collect())
        assert collapse_event_rows(df.limit(0), "who", "at", "what", "n").count() == 0
        assert collapse_event_rows(df, "who", "at", "what", "n", at_least=300).collect()[0]["entity"] == "one"
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = Counter()
    for who in {r[0] for r in rows} - {None}:
        own = sorted((r[1], r[3], r[2]) for r in rows if r[0] == who and r[1] is not None)
        for key, group in groupby(own, key=lambda r: (r[2], r[:2] if r[2] is None else None)):
            group = list(group)
            want[who, group[0][0], group[-1][0], key[0], len(group)] += 1
    assert got == want


def test_time_grows_with_a_row_s_length_not_with_its_square(spark):
    import time

    def seconds(n):
        df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i / 2).cast("int")).alias("e"))
        began = time.perf_counter()
        assert collapse_runs(df, "e").count() == n // 2
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(640_000) < 8 * max(0.3, seconds(160_000))


def brute(rows, share, lengths):
    entities = defaultdict(set)
    for src, entity, events in rows:
        if entity is not None and events is not None:
            entities[src, entity].add(tuple(events))
    support, total = Counter(), Counter()
    for (src, _), sequences in entities.items():
        total[src] += 1
        found = set()
        for s in sequences:
            level = {(): -1}
            for n in range(1, max(lengths) + 1):
                nxt = {}
                for p, end in level.items():
                    for j in range(end + 1, len(s)):
                        nxt.setdefault(p + (s[j],), j)
                level = nxt
                found |= {*level} if n in lengths else set()
        support.update((src, p) for p in found)
    return {(src, ">".join(f"E{x}" for x in p)): n for (src, p), n in support.items() if n >= total[src] * share}


@pytest.mark.parametrize("max_unit", [64, 1])
def test_patterns_agree_with_brute_force(spark, max_unit):
    rng = random.Random(max_unit)
    rows = [(rng.choice("ab"), rng.choice([None, *range(25)]), rng.choice([None, [], [rng.randrange(1, 6) for _ in range(rng.randrange(4, 14))], [rng.randrange(1, 30) for _ in range(6)]])) for _ in range(160)]
    rows = [(a, None if b is None else str(b), c) for a, b, c in rows] * 2
    df = spark.createDataFrame([(*r, "x") for r in rows], "src string, entity string, events array<int>, pattern string")
    got = {(r["src"], r["pattern"]): r["support"] for r in P.frequent_patterns(df, 0.1, max_unit=max_unit).collect()}
    assert got == brute(rows, 0.1, (3, 4)) and got


def test_an_entity_that_holds_a_third_of_all_rows(spark):
    rng = random.Random(3)
    rows = [("s", f"e{i}", [1, 2, 3, rng.randrange(4, 9)]) for i in range(60)] + [("s", "hot", [rng.randrange(1, 9) for _ in range(7)]) for _ in range(200)]
    df = spark.createDataFrame(rows, "src string, entity string, events array<int>")
    got = {(r["src"], r["pattern"]): r["support"] for r in P.frequent_patterns(df, 0.25, max_unit=8).collect()}
    assert got == brute(rows, 0.25, (3, 4))


def test_pivots_over_several_partitions_and_bounded_tables(spark, monkeypatch):
    rng = random.Random(5)
    rows = [("s", str(i), [rng.randrange(1, 5) for _ in range(rng.randrange(3, 30))]) for i in range(120)]
    monkeypatch.setattr(P, "UNITS_A_PARTITION", 10)
    monkeypatch.setattr(P, "TABLE_CELLS", 300)
    df = spark.createDataFrame(rows, "src string, entity string, events array<int>")
    got = {(r["src"], r["pattern"]): r["support"] for r in P.frequent_patterns(df, 0.5).collect()}
    assert got == brute(rows, 0.5, (3, 4)) and got


def test_no_rows(spark):
    df = spark.createDataFrame([], "src string, entity string, events array<int>")
    assert P.frequent_patterns(df, 0.1).count() == 0
    one = spark.createDataFrame([("s", "e", [1])], df.schema)
    assert P.frequent_patterns(one, 0.1).count() == 0
