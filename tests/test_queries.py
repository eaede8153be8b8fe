"""Every registered query with SQL against DuckDB on the small tables; the others for their rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from quakeframe.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"{value + 0.0:.4f}".replace("-0.0000", "0.0000")
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in registry.ORACLE_SQL:
        assert got
        return
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_entry_runs(spark):
    assert {r["phase"] for r in __spark_entry__.entry(spark).collect()} == {"P", "S"}


def test_all_names_are_registered_once():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert sum(len(m.QUERIES) for m in registry.MODULES) == len(registry.QUERIES)
