"""Every registered query of the engine's own operators against DuckDB, and the driver's contract."""

import os

import duckdb
import pandas as pd
import pytest

from sluice.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "NULL"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.6g}"
    return str(v)


def content(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got, wanted = catalogue.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert content(got) == content(wanted)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
