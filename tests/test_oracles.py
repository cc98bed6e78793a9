"""Each query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for plan in entry.PLANS for n in plan.ORACLES)

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    frame = entry.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in frame.collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns)) for r in cursor.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
