"""Every registered query with SQL gives the rows that the SQL gives."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else x


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, data, duck, name):
    df = registry.queries()[name](spark, data)
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    got, want = table_of(df.columns, df.collect()), table_of(names, cursor.fetchall())
    assert len(got) == len(want) and got
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            assert a == b if not isinstance(a, float) or not isinstance(b, float) else abs(a - b) < 1e-9 * max(1, abs(a)), (g, w)
            assert type(a) is type(b) or a is None or b is None, (g, w)


def test_entry(spark):
    assert registry.entry(spark).count() > 0
