"""Every query outside llm with SQL gives what DuckDB gives, on the small tables."""

import math

import duckdb
import pytest

from folioflow import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9))
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(plain(y) for y in x) + "]"
    return str(x)


def rows(table):
    return sorted(tuple(plain(r[k]) for k in sorted(r)) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, sf, db, name):
    got = plans.QUERIES[name](spark, sf).toArrow()
    want = db.sql(plans.SQL[name]).to_arrow_table()
    assert sorted(got.schema.names) == sorted(want.schema.names)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0
