import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace import runs
from loomtrace.operators import classify as C
from loomtrace.operators import prompts as M
from loomtrace.plans import boundary_queries as B
from loomtrace.sources import files

ANSWERS = {
    '{"label": "normal", "reason": "ok"}': ("NORMAL", "ok"), '```json\n{"label":"ANOMALY","reason":"x"}\n```': ("ANOMALY", "x"), 'Sure: {"label":"Normal","reason":"y"} done': ("NORMAL", "y"),
    '{"label":"NORMAL"}': ("INVALID_OUTPUT", ""), '{"label":"OTHER","reason":"y"}': ("INVALID_OUTPUT", ""), '{"label":1,"reason":"y"}': ("INVALID_OUTPUT", ""), "": ("INVALID_OUTPUT", ""), "no json": ("INVALID_OUTPUT", ""),
    '{"label":"NORMAL","reason":"  "}': ("INVALID_OUTPUT", ""),
}


def test_answers(spark):
    df = spark.createDataFrame([(t,) for t in [*ANSWERS, None]], "t string")
    for r in df.select("t", M.parsed_answer(F.col("t")).alias("x")).collect():
        assert tuple(r["x"]) == ANSWERS.get(r["t"], ("INVALID_OUTPUT", ""))
        if r["t"]:
            assert (C.read_answer(r["t"]) or "INVALID_OUTPUT") == r["x"]["label"]


def test_prompts_hold_no_label_of_the_query(spark):
    df = spark.createDataFrame([("q", [("NORMAL", "t1"), (None, "t2")]), ("r", []), ("s", None)], "text string, c array<struct<label:string,text:string>>")
    got = [r[0] for r in df.select(M.messages(F.col("text"), F.col("c"))).collect()]
    assert got[0][1]["content"].startswith("LABELED HISTORICAL REFERENCES:\nREFERENCE 1 — LABEL: NORMAL\nt1\n\nREFERENCE 2:\nt2\n\nQUERY BLOCK SEQUENCE:\nq\n\nReturn:")
    assert "REFERENCES:\nNONE\n" in got[1][1]["content"] and "REFERENCES:\nNONE\n" in got[2][1]["content"]


def test_response_texts(spark):
    df = spark.createDataFrame([('{"choices":[{"message":{"content":"hi"}}]}', '{"output":[{"type":"x"},{"type":"message","content":"yo"}]}'), ("{}", "{}")], "a string, b string")
    got = df.select(M.response_text(F.col("a"), "chat_completions"), M.response_text(F.col("b"), "input_text")).collect()
    assert [tuple(r) for r in got] == [("hi", "yo"), ("", "")]


def test_classification_repeats_asks_again_and_caches(spark):
    class Stubborn:
        """Refuses, fails, answers nonsense, then answers."""

        def __init__(self):
            self.steps = [C.Refused(1.0), C.Unavailable(), ("nonsense", 3), ('{"label":"NORMAL","reason":"r"}', 4)]

        def __call__(self, chat):
            step = self.steps.pop(0)
            if isinstance(step, Exception):
                raise step
            return step

    chats = spark.createDataFrame([(i, [("user", "same" if i < 2 else "other")]) for i in range(3)], "id long, chat array<struct<role:string,content:string>>")
    made, new = C.classify(chats, "stub")
    assert made.count() == 3 and new.count() == 2
    cache = spark.createDataFrame(new.collect(), new.schema)
    again, fresh = C.classify(chats, "stub", cache=cache)
    assert fresh.count() == 0
    assert {(r["cache_hit"], r["new_api_calls"], r["latency_seconds"]) for r in again.collect()} == {(True, 0, None)}
    assert C.classify(chats, "another", cache=cache)[1].count() == 2
    one = C.classify(chats.limit(1), "m", Stubborn, make_pacing=lambda: C.Pacing(sleep=lambda s: None))[0].first()
    assert (one["prediction"], one["request_count"], one["prompt_tokens"], one["rate_limit_retries"], one["transient_retries"]) == ("NORMAL", 2, 7, 1, 1)


def test_pacing_gives_up():
    waits = []

    def refuse(chat):
        raise C.Refused

    with pytest.raises(C.Refused):
        C.Pacing(refusals=4, wait=50, sleep=waits.append).ask(refuse, [])
    assert waits == [50, 100, 120, 120]


def test_encoding_averages_parts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "x" * 4500), (3, None), (4, "")], "id long, t string")
    got = {r["id"]: r["vector"] for r in C.encode_texts(df, "id", "t").collect()}
    e = C.HashEncoder()
    want = sum(e([p])[0] * len(p) for p in ("x" * 2000, "x" * 2000, "x" * 500))
    assert got[2] == pytest.approx(want / np.linalg.norm(want), abs=1e-6) and got[3] is None and len(got[4]) == 8


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b1", 's"1', '["E1", "E2"]', "line\nend", 2, "Normal", False), ("b2", None, "[]", None, 0, None, True)], files.SCHEMAS["block_sequences"])
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"), files.SCHEMAS["block_sequences"])
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    with pytest.raises(Exception, match="exists"):
        files.write_csv(df, str(tmp_path / "c"))
    with pytest.raises(ValueError, match="lacks"):
        files.read_csv(spark, str(tmp_path / "c"), files.SCHEMAS["log_templates"])
    files.write_jsonl(df, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), df.schema).count() == 2
    assert files.event_columns(["BlockId", "E10", "E2", "Label"]) == ["E2", "E10"]


def test_arrays_and_hashes(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.eye(3, dtype=np.float32))
    np.savez(tmp_path / "z.npz", a=np.zeros((2, 3)), b=np.array(["x"], dtype=object))
    assert files.npy_headers(tmp_path / "m.npy")[0]["shape"] == (3, 3)
    assert [h["dtype"] for h in files.npy_headers(tmp_path / "z.npz")] == ["<f8", "|O"]
    assert files.read_npy(spark, str(tmp_path / "m.npy")).where("id = 1").first()["vector"] == [0, 1, 0]
    row = files.provenance(spark, str(tmp_path / "m.npy")).first()
    assert row["sha256"] == files.file_sha256(tmp_path / "m.npy") and files.inventory(spark, str(tmp_path / "m.npy")).first()["bytes"] == row["bytes"]
    with pytest.raises(ValueError):
        files.save_json(tmp_path / "x.json", {"a": float("nan")})
    assert not (tmp_path / "x.json").exists()


def test_versions(tmp_path):
    assert files.next_version(tmp_path)[2] == 1
    for n in ("comparison.csv", "comparison_v2.csv", "comparison_v10.csv", "comparison_validation.csv"):
        (tmp_path / n).touch()
    assert files.next_version(tmp_path)[0].name == "comparison_v11.csv" and files.next_version(tmp_path, "validation")[2] == 2


CONFIG = {
    "models": ["a"], "methods": ["m0", "m5"], "model_profiles": {"a": {"display_name": "A", "model": "x"}}, "sampling": {"seed": 1, "validation": {"normal": 2, "anomaly": 1}, "test": "all"},
    "knn": {"feature": "sequence_ngram_hash", "k_candidates": [1, 3], "ngram_range": [2, 3], "hash_dim": 16},
    "retrieval": {"semantic": {"similarity": "cosine"}, "structure_aware": {"semantic": {"similarity": "cosine", "weight": 0.5, "normalization": "cosine_to_01"}, "template": {"similarity": "jaccard", "weight": 0.2}, "sequence": {"similarity": "normalized_lcs", "weight": 0.3}}},
    "selection": {"fixed": {"contexts_sweep": [1, 2]}, "adaptive": {"candidate_pool": 10, "threshold_quantiles": [0.5]}},
}


def test_settings_and_reuse(tmp_path):
    assert runs.problems(CONFIG) == []
    assert runs.problems(CONFIG | {"sampling": {"seed": "1", "validation": 0, "test": "all"}}) == ["sampling.seed", "sampling.validation"]
    knn = lambda **x: runs.problems(CONFIG | {"knn": CONFIG["knn"] | x})
    assert knn(ngram_range=[3, 2]) == ["knn.ngram_range"] == knn(ngram_range=[2]) and knn(hash_dim=True) == ["knn.hash_dim"] and knn(binary=1) == ["knn.binary"] and knn(k_candidates=[]) == ["knn.k_candidates"]
    assert runs.problems(CONFIG | {"models": ["b"]}) == ["models"] == runs.problems(CONFIG | {"models": ["a", "a"]})
    off = json.loads(json.dumps(CONFIG))
    off["retrieval"]["structure_aware"]["sequence"]["weight"] = 0.4
    assert runs.problems(off) == ["retrieval.structure_aware"] and len(runs.problems({})) > 15
    with pytest.raises(ValueError):
        runs.merged({"a": 1}, {"a": 2})
    assert runs.parameters(CONFIG, "m5", "mixed", 0.5)["weights"] == [0.5, 0.2, 0.3]
    assert runs.parameters(CONFIG, "m2", "normal")["selection"] == {"contexts_sweep": [1, 2]} and runs.parameters(CONFIG, "m1") == {"method": "m1"} and runs.tag("m1") == "m1" != runs.tag("m2", "mixed") == "m2_mixed"
    assert runs.for_model(CONFIG, "a")["llm"] == {"model": "x"} and runs.for_model(CONFIG, None)["run_name"] == "shared"
    one = runs.signature(CONFIG, "m5", "mixed", {"kb": "h"})
    assert one == runs.signature(json.loads(json.dumps(CONFIG)), "m5", "mixed", {"kb": "h"}) != runs.signature(CONFIG, "m5", "mixed", {"kb": "i"})
    calls = []
    make = lambda: calls.append(1) or {"f1": 1.0}
    for sign in ("s", "s", "t"):
        assert runs.run_once(tmp_path, "r", sign, make)["signature"] == sign
    assert len(calls) == 2
    with pytest.raises(ValueError):
        runs.locked_threshold(tmp_path, "m5", "s")
    runs.lock_threshold(tmp_path, "m5", "s", {"threshold": 0.5})
    assert runs.locked_threshold(tmp_path, "m5", "s") == 0.5
    with pytest.raises(ValueError):
        runs.locked_threshold(tmp_path, "m5", "other")
    (tmp_path / "q.txt").write_text("x")
    runs.lock(tmp_path, ["q.txt"])
    assert runs.changed(tmp_path) == []
    (tmp_path / "q.txt").write_text("y")
    assert runs.changed(tmp_path) == ["q.txt"]


@pytest.mark.parametrize("name", ["file_inventory", "file_sha256"])
def test_all_files_of_a_folder_are_listed_and_hashed(spark, tmp_path, name):
    (tmp_path / "t.parquet").mkdir()
    for file, text in (("a b.parquet", b"x" * 3_000_000), ("t.parquet/part-0", b"1"), ("t.parquet/part-1", b"22")):
        (tmp_path / file).write_bytes(text)
    want = {str(p.relative_to(tmp_path)): (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.rglob("*") if p.is_file()}
    got = {r["name"]: tuple(r)[1:] for r in B.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == (want if name == "file_sha256" else {n: x[:1] for n, x in want.items()})


def test_answers_of_all_rows_are_parsed_as_by_json(spark):
    data, blanks = "/root/testdata/sf0.01", " \t\r\n"
    answers = {r["row_id"]: r["text"] for r in B._answers(spark, data).collect()}
    want = {}
    for row, text in answers.items():
        found = json.loads(text[text.index("{") : text.rindex("}") + 1]) if "{" in text else {}
        label, reason = found.get("label", "").strip(blanks).upper(), found.get("reason", "").strip(blanks)
        want[row] = (label, reason) if label in ("NORMAL", "ANOMALY") and reason else ("INVALID_OUTPUT", "")
    got = {r["row_id"]: (r["label"], r["reason"]) for r in B.QUERIES["parse_llm_output_all"](spark, data).collect()}
    assert got == want and len(got) == spark.read.parquet(f"{data}/block_sequences.parquet").count()
    assert len(got) > B.QUERIES["parse_llm_output"](spark, data).count()
