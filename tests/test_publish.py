import json

import pytest
from pyspark.sql import functions as F

from loomtrace import __main__ as cli
from loomtrace.operators import experiment as X
from loomtrace.operators.classify import encode_texts
from loomtrace.plans.base import templates, traces
from loomtrace.sources import publish

DATA = "/root/testdata/sf0.001"


def counts(checks):
    return {r["check"]: r["violations"] for r in checks.collect()}


def test_staged_folders_appear_at_once_or_not_at_all(spark, tmp_path):
    out = tmp_path / "set"
    with pytest.raises(RuntimeError), publish.staged(spark, str(out)) as part:
        spark.range(3).write.parquet(f"{part}/a")
        raise RuntimeError
    assert [*tmp_path.iterdir()] == []
    with publish.staged(spark, str(out)) as part:
        spark.range(3).write.parquet(f"{part}/a")
        assert not out.exists()
    assert spark.read.parquet(f"{out}/a").count() == 3
    with pytest.raises(FileExistsError), publish.staged(spark, str(out)):
        pass


def test_block_sequences_are_sound(spark):
    from loomtrace.operators.verify import verify_delivered

    rows = traces(spark, DATA)
    made = publish.block_sequences(rows, templates(spark, DATA))
    assert made.count() == rows.count()
    knowledge = made.select(F.col("trace_signature").alias("trace_id"), "event_ids", F.lit("x").alias("template_text")).distinct()
    labels = rows.select("block_id", F.col("label").alias("truth"))
    assert {*counts(verify_delivered(made, knowledge, labels)).values()} == {0}


def test_tampered_tables_are_found(spark):
    from loomtrace.operators.verify import verify_delivered

    made = publish.block_sequences(traces(spark, DATA), templates(spark, DATA))
    first, last = made.agg(F.min("block_id"), F.max("block_id")).first()
    bad = made.withColumns({
        "event_ids": F.when(F.col("block_id") == first, '["E1","E99"]').otherwise(F.col("event_ids")),
        "sequence_length": F.when(F.col("block_id") == last, 0).otherwise(F.col("sequence_length")),
        "trace_signature": F.when(F.col("block_id") == last, F.lit("0" * 64)).otherwise(F.col("trace_signature")),
    }).unionByName(made.where(F.col("block_id") == last))
    knowledge = spark.createDataFrame([("0" * 64, '["E1"]', None), ("0" * 64, None, "t"), ("f" * 64, "[E1", "t")], "trace_id string, event_ids string, template_text string")
    labels = spark.createDataFrame([(last, "Normal")], "block_id string, truth string")
    got = counts(verify_delivered(bad, knowledge, labels))
    wrong_label = made.where(F.col("block_id") == last).first()["label"] == "Anomaly"
    want = {"events_unreadable": 1, "length_differs": 1, "signature_differs": 1, "block_ids_repeated": 1, "knowledge_ids_repeated": 1, "knowledge_id_differs": 1, "knowledge_texts_missing": 1, "knowledge_without_block": 1, "label_differs": 2 * wrong_label}
    assert {k: got[k] for k in want} == want and got["block_ids_missing"] == got["events_missing"] == 0


def test_vectors_are_encoded_once_for_a_signature(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    encode = lambda rows: encode_texts(rows, "id", "text")
    assert publish.encoded_tables(tmp_path, {"x": df}, encode, "s") == {"x": True}
    assert publish.encoded_tables(tmp_path, {"x": df}, encode, "s") == {"x": False}
    vectors = publish.encoded(spark, tmp_path, "x", "s")
    assert {*counts(publish.vector_checks(df, vectors, "id")).values()} == {0}
    assert counts(publish.vector_checks(df.where("id = 1").withColumn("id", F.lit(7).cast("long")), vectors.unionByName(vectors.limit(1)), "id")) == {"rows_without_vector": 1, "vectors_without_row": 2, "repeated_vectors": 1, "empty_vectors": 0}
    with pytest.raises(ValueError):
        publish.encoded(spark, tmp_path, "x", "t")
    assert publish.encoded_tables(tmp_path, {"x": df}, encode, "t") == {"x": True}


def test_mixed_knowledge_and_report_rows(spark):
    rows = [("normal", 0, "Normal", "a"), ("normal", 1, "Normal", "b"), ("anomaly", 0, "Anomaly", "a"), ("mixed", 0, "Normal", "a"), ("mixed", 1, "Normal", "b"), ("mixed", 2, "Anomaly", "a")]
    df = spark.createDataFrame(rows, "variant string, kb_index int, label string, pattern string")
    assert counts(publish.mixed_knowledge_checks(df)) == {"mixed_entries_differ": 0}
    assert counts(publish.mixed_knowledge_checks(df.where("NOT (variant = 'mixed' AND kb_index = 1)"))) == {"mixed_entries_differ": 1}
    assert counts(publish.comparable(spark.createDataFrame([("h",), ("i",), (None,)], "query_manifest string"), "h")) == {"rows_of_other_queries": 2}


def test_identity_of_predictions(spark):
    queries = spark.createDataFrame([("a", "Normal"), ("b", "Anomaly")], "block_id string, label string")
    said = spark.createDataFrame([("m1", None, "a", "NORMAL"), ("m1", None, "a", "NORMAL"), ("m2", "k", "a", "ANOMALY"), ("m2", "k", "b", "ANOMALY"), ("m2", "k", "z", "NORMAL")], "method string, kb string, block_id string, label string")
    assert counts(X.identity_violations(said, queries, "method", "kb")) == {"predictions_of_unknown_queries": 1, "prediction_labels_differ": 1, "repeated_predictions": 1, "missing_predictions": 1}
    with pytest.raises(ValueError, match="test"):
        X.require_both_labels(spark.createDataFrame([("validation", "Normal"), ("validation", "Anomaly"), ("test", "Normal")], "split string, label string"))


def test_experiment_and_report_from_the_command_line(spark, tmp_path, capsys):
    out = str(tmp_path / "runs")
    assert cli.main(["experiment", DATA, out]) == 0 and cli.main(["report", out]) == 0
    summary = {(r["method"], r["kb"], r["context_setting"]): r for r in spark.read.parquet(f"{out}/summary").collect()}
    assert len(summary) == 2 + 6 * len(X.SWEEP) + 6 and len({r["queries"] for r in summary.values()}) == 1
    assert summary["m2", "mixed", "k3"]["average_contexts"] == 3 and summary["m1", None, None]["average_contexts"] == 0
    matrix = spark.read.option("header", True).csv(f"{out}/confusion")
    assert matrix.where("run = 'm1'").count() == 4 and "| m5 | mixed |" in (tmp_path / "runs/REPORT.md").read_text()
    assert cli.main(["embed", DATA, out]) == 0 and cli.main(["list"]) == 0 and "rag_summary" in capsys.readouterr().out
    with pytest.raises(FileExistsError):
        cli.main(["experiment", DATA, out])
    papers = str(tmp_path / "profile")
    cli.stage(spark, ("duplicate_summary", "quality_counters"), DATA, papers)
    assert json.loads((tmp_path / "profile/schemas.json").read_text())["duplicate_summary"]["blocks"] == "bigint"
    paper = json.loads((tmp_path / "profile/provenance.json").read_text())
    assert paper["checks"]["malformed_features"] >= 0 and len(paper["sources"]) > 10 and all(len(f["sha256"]) == 64 for f in paper["sources"])
