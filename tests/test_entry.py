import subprocess
import sys

import pytest

import __spark_entry__ as entry


def test_queries_can_be_listed_without_a_session():
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], capture_output=True, text=True, timeout=100)
    assert out.returncode == 0, out.stderr
    assert {*entry.oracle_sql()} <= {*entry.queries()}


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["src", "row_id", "reason"] and df.count() > 0


CORE = [n for n in entry.registry.queries() if n not in entry.registry.oracles()]


@pytest.mark.parametrize("name", CORE)
def test_queries_without_sql_run(spark, name):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() >= 0
