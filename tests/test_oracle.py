"""Every registered query with SQL gives the rows of its SQL in DuckDB."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    rel = duck.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    want = Counter(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())
    got = Counter(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    assert sum(want.values()) > 0
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
