"""Every registered query against its oracle SQL at the smallest scale.

HEDDLE_QUERIES limits the run to names with one of its comma-separated prefixes."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from heddle.plans.registry import TABLES

SF_DIR = "/root/testdata/sf0.001"
PREFIXES = tuple(p for p in os.environ.get("HEDDLE_QUERIES", "").split(",") if p)
NAMES = [n for n in entry.queries() if not PREFIXES or n.startswith(PREFIXES)]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for table in TABLES:
        c.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return c


def rounded(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


def in_order(rows):
    return sorted((rounded(r) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    rows = in_order(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    oracle = entry.oracle_sql().get(name)
    if oracle is None:
        assert rows
        return
    listed = ", ".join(f'"{c}"' for c in columns)
    assert sorted(con.sql(oracle).columns) == columns
    assert rows == in_order(con.sql(f"select {listed} from ({oracle})").fetchall())


def test_entry_is_the_flagship(spark):
    assert entry.entry(spark).count() > 0
