from loomtrace.__main__ import main
from loomtrace.operators import sets as K
from loomtrace.operators.report import markdown


def frame(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def test_key_sets(spark):
    r = K.overlap(frame(spark, ["a", "b", "b", None]), frame(spark, ["b", "c"])).first()
    assert (r["in_a"], r["in_b"], r["either"], r["both"], r["only_a"], r["only_b"], r["equal"], r["a_in_b"]) == (2, 2, 3, 1, 1, 1, False, False)
    r = K.overlap(frame(spark, []), frame(spark, ["b"])).first()
    assert (r["in_a"], r["a_in_b"], r["b_in_a"]) == (0, True, False)
    a, b = frame(spark, ["a", "b", None]), frame(spark, ["b", "b", None])
    assert [x["key"] for x in K.present(a, b, "key").collect()] == ["b"]
    assert {x["key"] for x in K.absent(a, b, "key").collect()} == {"a", None}
    assert {(x["key"], x["there"]) for x in K.with_presence(a, b, "key", "there").collect()} == {("a", False), ("b", True), (None, False)}


def test_report_and_command_line(spark, tmp_path, capsys):
    text = markdown("T", {"some_part": [{"a": 1234, "b": None, "c": 0.5, "d": "x|y"}], "none": []}, "f")
    assert "## Some part" in text and "| 1,234 | – | 0.5 | x\\|y |" in text and "(no rows)" in text
    assert main(["list"]) == 0 and "quality_counters" in capsys.readouterr().out
    assert main(["verify", "/root/testdata/sf0.001"]) == 0
    assert main(["profile", "/root/testdata/sf0.001", str(tmp_path / "p")]) == 0
    assert "## Quality counters" in (tmp_path / "p" / "REPORT.md").read_text()
    assert main(["prepare", "/root/testdata/sf0.001", str(tmp_path / "q")]) == 0
    assert spark.read.parquet(str(tmp_path / "q" / "normal_kb")).count() > 0
