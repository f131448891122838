"""Every query outside the optional subpackage against its SQL twin, over whole tables."""

import os

import duckdb
import pytest

from quern.plans import catalog


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda x: repr(round(x, 6)) if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, folder, duck, name):
    df = catalog.QUERIES[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if name in catalog.SQL:
        twin = duck.sql(catalog.SQL[name])
        assert sorted(df.columns) == sorted(twin.columns)
        assert canon(rows, df.columns) == canon(twin.fetchall(), twin.columns)


def test_entry(spark, folder):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["user_id", "domain", "mean_score", "n"]
