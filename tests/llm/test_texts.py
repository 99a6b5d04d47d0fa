import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtrace.llm import encode as B
from loomtrace.llm import mixing as X
from loomtrace.llm import truncation as C
from loomtrace.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reference():
    own = Tokenizer.from_file(B.VOCABULARY.replace(".tiktoken", ".json"))
    own.encode_special_tokens = True
    return own


def test_encoding_agrees_with_two_libraries(reference):
    e, rng = B.Encoder(), random.Random(0)
    other = tiktoken.Encoding("own", pat_str=B.PIECES, mergeable_ranks=B.read_ranks(B.VOCABULARY), special_tokens={})
    texts = ["a", " ", "\n\n x", "it's we're they'll", "<|endoftext|>", "é" * 99, "日本語" * 30, " " * 500, "aaaaaaab" * 40] + ["".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 90))) for _ in range(300)]
    texts += ["".join(chr(rng.randrange(1, 0x2FFF)) for _ in range(rng.randrange(1, 60))) for _ in range(100)]
    for t in texts:
        assert e(t) == other.encode_ordinary(t) == reference.encode(t, add_special_tokens=False).ids, t


def test_encoding_of_documents(spark, reference):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: r["ids"] for r in QUERIES["p7_ids"](spark, DATA).collect()}
    assert got == {i: reference.encode(t or "", add_special_tokens=False).ids for i, t in docs.items()}


def test_encoding_of_odd_rows(spark):
    rows = [(1, None, "x"), (1, "", "x"), (2, "ab " * 100_000, "x"), (3, "a" * 200_000, "x")]
    df = spark.createDataFrame(rows, "k long, t string, ids string")
    got = B.encode(df, "k", "t").orderBy("k", F.size("ids")).collect()
    assert [len(r["ids"]) for r in got[:2]] == [0, 0] and B.Encoder()("ab " * 100_000) == got[2]["ids"]
    assert B.encode(df, "k", "t", only_count=True, keep=("ids",)).agg(F.sum("n_tokens")).first()[0] == sum(len(r["ids"]) for r in got)
    assert B.encode(df.limit(0), "k", "t").count() == 0


SENTENCES = ["The mirror on dn-1234 caught up after 12 ms.", "Block blk_77 was sealed on dn-1 without help.", "No page was sent, since the lead was looking already.", "Does anybody know why dn-9 keeps asking?"]


def corpus():
    rng = random.Random(1)
    rows = []
    for i in range(600):
        body = " ".join(rng.choice(SENTENCES) for _ in range(rng.randrange(2, 6)))
        rows.append((i, body + rng.choice(["", "", "\nPriority: low", "\n-- end of note", "\nMore tomorrow..."]), "Shift-Journal", False))
    for i in range(60):
        full = " ".join(rng.choice(SENTENCES) for _ in range(4))
        cut = rng.randrange(60, len(full) - 3)
        while full[:cut].rstrip()[-1] in ".?!":
            cut -= 1
        rows.append((1000 + i, full[:cut] + rng.choice(["", "", "...", "…", " [+", " [truncated]"]), "shift_journal ", True))
    logs = ["\n".join(f"t={j} node=dn-{j} op=seal took={j}ms rc=0" for j in range(rng.randrange(2, 6))) for _ in range(80)]
    rows += [(2000 + i, t, "log", False) for i, t in enumerate(logs)] + [(3000 + i, t[: len(t) - 8 - i], "log", True) for i, t in enumerate(logs[:8])]
    return rows + [(4000, None, None, False), (4001, "", "log", False), (4002, " \n ​", "log", False)]


def test_cut_texts(spark):
    rows = corpus()
    copies = [(5000 + i, rows[601][1], "log", True) for i in range(300)]  # copies of a cut text prove nothing
    df = spark.createDataFrame(rows + copies, "doc_id long, text string, source string, want boolean")
    got = {r["doc_id"]: r["cut"] for r in C.truncated_texts(df, "doc_id", "text").collect()}
    wrong = [(r[0], r[1]) for r in rows + copies if got[r[0]] != r[3]]
    assert len(got) == len(rows + copies) and wrong == []
    shares = {r["source"]: (r["n_docs"], r["n_cut"]) for r in C.truncation_by_source(C.truncated_texts(df, "doc_id", "text", ("source",))).collect()}
    assert shares == {"shift_journal": (660, 60), "log": (390, 308), None: (1, 0)}


def test_cut_texts_of_odd_tables(spark):
    schema = "doc_id long, text string, cut string, segment string"
    assert C.truncated_texts(spark.createDataFrame([], schema), "doc_id", "text").count() == 0
    df = spark.createDataFrame([(1, None, "x", "y"), (2, "word " * 100_000, "x", "y"), (2, "A whole text.", None, None)], schema)
    got = sorted((r["doc_id"], r["cut"]) for r in C.truncated_texts(df, "doc_id", "text").collect())
    assert got == [(1, False), (2, False), (2, True)]


def test_longer_counts_see_nested_prefixes():
    import pyarrow as pa

    words = sorted(["abcdefgh", "abcdefghi", "abcdefghij", "abcdefgx", "b"])
    batch = pa.RecordBatch.from_arrays([pa.array(words), pa.array([1, 2, 4, 8, 16]), pa.array([1, 1, 0, 1, 1]), pa.array([0] * 5)], names=["segment", "n", "ends", "part"])
    got = {r["segment"]: r["longer"] for b in C._longer_counts(iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist() if r["kind"] != C._FIRST}
    assert got == {"abcdefgh": 6, "abcdefghi": 4, "abcdefgx": 0, "b": 0}


def sized(spark, counts):
    rng = random.Random(4)
    rows = [(f"{s}{i}", s, rng.choice(["en", "de", None]), rng.choice(["t1", "t2", None]), rng.randrange(20, 200)) for s, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "id string, source string, lang string, topic string, n_tokens long")


def test_mix_meets_its_shares(spark):
    df = sized(spark, {"a": 900, "B-C": 300, "small": 30, "other": 50})
    mixed, report, marginals = X.mix_sources(df, "id", [("A", 0.5, 1), ("b_c ", 0.3, 2), ("small", 0.1, 4), ("missing", 0.1, 3)])
    got = {r["source"]: r for r in report.collect()}
    assert {*got} == {"a", "b_c", "small", "missing"} and got["missing"]["mix_tokens"] == 0
    for name, share in (("a", 0.5), ("b_c", 0.3), ("small", 0.1)):
        assert abs(got[name]["actual_share"] - share / 0.9) < 0.01 and abs(got[name]["reachable_share"] - share / 0.9) < 1e-9
    most = {r["source"]: r["m"] for r in mixed.groupBy("source").agg(F.max("copies").alias("m")).collect()}
    assert most["small"] == 4 and most["a"] == 1 and most["b_c"] <= 2
    assert mixed.select("id").distinct().count() == mixed.count() and mixed.where("source = 'other'").count() == 0
    assert got["small"]["at_cap"] and not got["a"]["at_cap"] and got["small"]["unused_tokens"] == 0 < got["a"]["unused_tokens"]
    held = {(r["axis"], r["value"]): r for r in marginals.collect()}
    assert {*held} == {("lang", x) for x in ("en", "de", "(other)")} | {("topic", x) for x in ("t1", "t2", "(other)")}
    assert all(abs(r["target_share"] - r["actual_share"]) < 0.02 for r in held.values())
    again = X.mix_sources(df.repartition(7), "id", [("A", 0.5, 1), ("b_c ", 0.3, 2), ("small", 0.1, 4), ("missing", 0.1, 3)])[0]
    assert mixed.exceptAll(again).count() == 0


def test_mix_that_cannot_be_met(spark):
    df = sized(spark, {"a": 200, "small": 10})
    _, report, _ = X.mix_sources(df, "id", [("a", 0.5, 2), ("small", 0.5, 2)], total_tokens=20_000)
    got = {r["source"]: r for r in report.collect()}
    assert got["small"]["mix_tokens"] == 2 * got["small"]["available_tokens"] and not got["small"]["met"]
    assert abs(got["a"]["mix_tokens"] - 10_000) < 200


def test_mix_of_nothing(spark):
    empty = sized(spark, {"a": 1}).limit(0)
    mixed, report, _ = X.mix_sources(empty, "id", [("a", 1.0, 1), (None, 1.0, 1), ("b", None, None)])
    assert mixed.count() == 0 and [tuple(r)[:2] for r in report.orderBy("source").collect()] == [("a", 1.0), ("b", 0.0)]


def test_raking():
    tokens = np.array([100.0, 100, 200, 50])
    axes = [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])]
    w = X.rake(tokens, axes, [np.array([100.0, 100]), np.array([150.0, 50])], np.array([1, 1, 1, 1.0]))
    got = tokens * w
    assert np.allclose([got[:2].sum(), got[2:].sum()], 100) and np.allclose([got[[0, 2]].sum(), got[[1, 3]].sum()], [150, 50], atol=1e-3) and (w <= 1).all()


def test_language_keys(spark):
    df = spark.createDataFrame([(x,) for x in ("EN", " en-US", "vie", None, "", "klingon", "de_AT")], "l string")
    assert [r[0] for r in df.select(X.language_key(F.col("l"))).collect()] == ["en", "en", "vi", "(other)", "(other)", "(other)", "de"]


def test_topics_part_unlike_texts(spark):
    kinds = ["the database index was rebuilt after the failed migration", "rain and wind are expected over the northern hills tonight", "add two eggs and flour then stir the dough slowly"]
    rows = [(i, kinds[i % 3] + f" {i}", "x") for i in range(90)] + [(90, None, "x"), (91, "", "x"), (92, " ", "x")]
    df = spark.createDataFrame(rows, "id long, body string, topic string")
    got = {r["id"]: (r["topic"], r["n_tokens"]) for r in X.sized_documents(df, "id", "body").collect()}
    own = [{got[i][0] for i in range(k, 90, 3)} for k in range(3)]
    assert not own[0] & own[1] and not own[1] & own[2] and not own[0] & own[2] and len(got) == 93
    assert got[90] == ("(other)", 0) and got[91] == ("(other)", 0) and got[92][0] == "(other)" and got[92][1] > 0
    assert X.sized_documents(df.limit(0), "id", "body").count() == 0


def test_topics_come_from_every_document(spark):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(12)) for _ in range(12)]
    rows = [(i, texts[i % 4]) for i in range(12_000)] + [(20_000 + i, t) for i, t in enumerate(texts[4:])]
    df = spark.createDataFrame(rows, "id long, body string")
    sized = X.sized_documents(df, "id", "body")
    topics = sized.join(df, "id").groupBy("body").agg(F.collect_set("topic").alias("own")).collect()
    assert len(topics) == 12 and all(len(r["own"]) == 1 for r in topics) and len({r["own"][0] for r in topics}) == 12
    assert sized.exceptAll(X.sized_documents(df.repartition(7), "id", "body")).count() == 0


def test_mix_query(spark):
    report = {r["source"]: r for r in QUERIES["p8_report"](spark, DATA).collect()}
    assert len(report) == 8 and QUERIES["p8_mix"](spark, DATA).count() == sum(r["n_docs"] for r in report.values())
    total = {r["source"]: r for r in QUERIES["p8_report_total"](spark, DATA).collect()}
    assert any(r["at_cap"] and r["mix_tokens"] < r["target_tokens"] for r in total.values())
    assert {r["axis"] for r in QUERIES["p8_marginals"](spark, DATA).collect()} == {"lang", "topic"}


def test_prefix_counts_over_many_parts(spark):
    import random

    rng = random.Random(4)
    words = {"t=0 node " + "".join(rng.choice("ab é") for _ in range(rng.randrange(9))) for _ in range(400)} | {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(300)} | {"t", "t=0", "t=0 node", "z"}
    rows = [(w, rng.randrange(1, 9), rng.randrange(2)) for w in sorted(words)]
    want = {(w, n, e, sum(m for v, m, _ in rows if v != w and v.startswith(w))) for w, n, e in rows if e}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for parts in ("1", "3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = C.prefix_counts(spark.createDataFrame(rows, "segment string, n long, ends long")).collect()
            assert {tuple(r) for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_evidence_of_cuts(spark):
    texts = [f"node {i} was restarted by the operator on duty" for i in range(40)] + ["node 7 was restarted by the op", "All is well. [truncated]", "unlike anything that anybody wro", "All is well.", None]
    found = C.truncated_texts(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string"), "doc_id", "text", ("source",))
    got = {r["doc_id"]: r["evidence"] for r in found.collect()}
    assert [got[i] for i in range(38, 45)] == [None, None, "prefix", "mark", "ending", None, None]
    (row,) = C.truncation_by_source(found).collect()
    assert (row["n_docs"], row["n_cut"], row["by_prefix"], row["by_mark"], row["by_ending"]) == (45, 3, 1, 1, 1)
