"""Every registered query with a SQL twin against DuckDB at the smallest scale; the others for a stable schema."""

import os

import duckdb
import pytest

from tessera.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        f = f"{DIR}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{f + '/*' if os.path.isdir(f) else f}')")
    return c


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    return round(x, 6) if isinstance(x, float) else x


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(r[k]) for k in order]) for r in data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, DIR)
    got = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, got.fetchall())


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_query_runs(spark, name):
    df = registry.queries()[name](spark, DIR)
    assert df.columns == registry.queries()[name](spark, DIR).columns and df.take(1)
