"""Every query of the catalogue against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from rangeloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in catalogue.ORACLES:
        rel = duck.sql(catalogue.ORACLES[name])
        assert sorted(df.columns) == sorted(rel.columns)
        order = [rel.columns.index(c) for c in sorted(rel.columns)]
        assert got == sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    else:
        assert got
