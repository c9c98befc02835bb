"""Every catalogue query against its SQL on the smallest tables, and the driver's entry points."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from barforge import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def same(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.1e-7)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted(names) == cols and len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if not all(map(same, g, w))]
    assert not bad, bad[:3]


def test_entry(spark):
    row = __spark_entry__.entry(spark).first()
    assert row["trades"] > 5 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
