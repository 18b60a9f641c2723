"""Every registered core query runs, and gives the rows of its SQL, on the smallest tables."""

import datetime as dt

import duckdb
import pytest

from folio.plans import catalogue as C

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(C.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = C.QUERIES[name](spark, sf_dir)
    got = sorted((tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    assert got
    if name in C.ORACLES:
        r = duck.sql(C.ORACLES[name])
        order = sorted(range(len(r.columns)), key=lambda i: r.columns[i])
        assert sorted(r.columns) == sorted(df.columns)
        assert got == sorted((tuple(plain(x[i]) for i in order) for x in r.fetchall()), key=repr)
