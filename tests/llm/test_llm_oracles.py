"""Queries with SQL give the rows that the SQL gives on the same tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from loomtrace.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    return (None if math.isnan(x) else round(x, 6) + 0.0) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, db, name):
    made = QUERIES[name](spark, DATA)
    columns = sorted(made.columns)
    found = db.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in made.collect()) == want
