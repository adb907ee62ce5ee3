"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from lorekeep.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{FOLDER}/{t}.parquet'")
    return c


def rows(values):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in values)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    own = registry.queries()[name](spark, FOLDER)
    columns = sorted(own.columns)
    other = duck.sql(registry.oracle_sql()[name])
    assert sorted(other.columns) == columns
    assert rows(map(tuple, own.select(*columns).collect())) == rows(other.select(*columns).fetchall())


def test_ledger_applies_each_record_once(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    got = registry.queries()["streaming_ledger"](spark, FOLDER)
    assert got.count() == spark.read.parquet(f"{FOLDER}/events.parquet").distinct().count()
