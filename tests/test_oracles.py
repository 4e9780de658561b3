"""Every query with SQL gives the same rows in DuckDB."""

import datetime

import duckdb
import pytest

from marketloom.plans import registry
from marketloom.sources.staging import clear_staged

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_small}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v.date() if isinstance(v, datetime.datetime) and v.time() == datetime.time() else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, sf_small, duck, name):
    df = registry.QUERIES[name](spark, sf_small)
    found = duck.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    clear_staged(spark)
    assert got == sorted((tuple(map(plain, r)) for r in found.fetchall()), key=str)
