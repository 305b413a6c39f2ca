"""Every query with SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from concord.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("part", "supplier", "lineitem", "embeddings")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 9)
    return value


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(v[k]) for k in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    said = duck.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(said.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(said.columns, said.fetchall())
