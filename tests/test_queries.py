"""Every signal query against its SQL, on the smallest tables."""

import os

import pytest

from tidemark.plans import signal_queries

TABLES = "events embeddings documents labels".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple("" if v is None else repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(signal_queries.ORACLE_SQL))
def test_query(spark, sf_dir, duck, name):
    got = signal_queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*(f"`{c}`" for c in columns)).collect()]
    want = duck.execute(signal_queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows and plain(rows) == plain(tuple(r[k] for k in order) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert os.path.exists(e.__file__)
