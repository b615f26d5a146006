import glob
import os

import duckdb
import pytest

from metaframe.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    got = canonical(df.columns, df.collect())
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == canonical(names, cursor.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
