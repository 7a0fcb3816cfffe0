"""Every query with SQL gives the same rows in DuckDB, over whole tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E
from folioflow.plans.sql import ORACLE_SQL
from folioflow.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(records, columns):
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(clean(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert got
        return
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(got, df.columns) == rows(want.fetchall(), columns)


def test_registry(spark):
    assert set(E.oracle_sql()) <= set(E.queries())
    assert E.entry(spark).count() > 0
