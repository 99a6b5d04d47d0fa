import pytest

from loomtrace.operators import evaluation as E


def rows(spark, data):
    return spark.createDataFrame(data, "label string, prediction string")


def test_rates(spark):
    r = E.confusion(rows(spark, [("ANOMALY", "ANOMALY")] * 2 + [("ANOMALY", "NORMAL"), ("NORMAL", "ANOMALY"), ("NORMAL", "NORMAL")])).first()
    assert (r["TP"], r["FN"], r["FP"], r["TN"]) == (2, 1, 1, 1)
    assert r["precision"] == r["recall"] == r["f1"] == pytest.approx(2 / 3)


def test_rates_are_null_with_an_invalid_answer_and_zero_without_positives(spark):
    r = E.confusion(rows(spark, [("ANOMALY", "ANOMALY"), ("NORMAL", "INVALID_OUTPUT"), ("ANOMALY", None)])).first()
    assert (r["precision"], r["recall"], r["f1"], r["invalid_normal"], r["invalid_anomaly"], r["TP"]) == (None, None, None, 1, 1, 1)
    r = E.confusion(rows(spark, [("NORMAL", "NORMAL")])).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0, 0, 0)
    r = E.confusion(rows(spark, [])).first()
    assert (r["queries"], r["f1"], r["invalid_output_rate"]) == (0, 0, 0)


def test_choices(spark):
    ks = spark.createDataFrame([(5, 0.9, 0.5), (3, 0.9, 0.5), (1, 0.8, 0.9)], "k int, f1 double, recall double")
    assert E.best_k(ks).first()["k"] == 3
    th = spark.createDataFrame([(0.25, 0.3, 0.9000001, 5.0), (0.5, 0.5, 0.9, 3.0), (0.75, 0.7, 0.9, 3.0)], "quantile double, threshold double, f1 double, average_contexts double")
    assert E.best_threshold(th).first()["threshold"] == 0.5


def test_report(spark):
    schema = "model_profile string, method string, retrieval string, selection string, kb string, context_setting string, contexts int, TP long, TN long, FP long, FN long, f1 double, average_contexts double, is_tuning_run boolean"
    data = [
        ("m", "m2", "semantic", "fixed", "mixed", "k1", 1, 1, 1, 0, 0, 0.8, 1.0, False), ("m", "m2", "semantic", "fixed", "mixed", "k2", 2, 1, 1, 0, 0, 0.8, 2.0, False),
        ("m", "m3", "semantic", "adaptive", "mixed", "adaptive", None, 1, 1, 0, 0, 0.9, 0.5, None), ("m", "m3", "semantic", "adaptive", "mixed", "q", None, 1, 1, 0, 0, 1.0, 0.5, True), ("m", "m1", None, None, None, None, None, 1, 1, 0, 0, None, 0.0, False),
    ]
    got = {(r["method"], r["context_setting"]): r for r in E.comparison_report(spark.createDataFrame(data, schema), (1, 2)).collect()}
    assert len(got) == 4
    a = got["m3", "adaptive"]
    assert (a["best_fixed_context_setting"], a["fixed_kmax_f1"], a["best_overall"], a["context_reduction_vs_fixed_contexts"]) == ("k1", 0.8, True, 0.75)
    assert a["delta_f1_vs_best_fixed"] == pytest.approx(0.1)
    assert got["m2", "k1"]["best_in_method_kb"] and got["m2", "k2"]["best_in_method_kb"]
    assert got["m1", None]["best_overall"] is False
    ordered = E.report_order(spark.createDataFrame(data, schema)).collect()
    assert ordered[0]["method"] == "m1"
