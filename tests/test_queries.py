"""Every registered query against its SQL on the small tables."""

import glob
import math
import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
import __spark_entry__ as entry  # noqa: E402

QUERIES = entry.QUERIES


def canon(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(entry.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    a = sorted((tuple(canon(r[c]) for c in order) for r in df.collect()), key=repr)
    b = sorted((tuple(canon(v) for v in r) for r in want.select(*(f'"{c}"' for c in order)).fetchall()), key=repr)
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b) if not all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-4 * max(1, abs(q)) for p, q in zip(x, y))]
    assert not bad, bad[:3]


def test_entry(spark):
    assert len(entry.entry(spark).columns) == 4
