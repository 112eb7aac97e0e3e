"""Every ledger query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from docledger.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def rows(df, columns):
    return sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLES:
        assert len(found)
        return
    expected = duck.sql(ORACLES[name]).df()
    columns = sorted(expected.columns)
    assert sorted(found.columns) == columns
    assert rows(found, columns) == rows(expected, columns)
