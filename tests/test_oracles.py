"""Every query with a statement gives the statement's rows on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from siltstone.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(one, row)) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_statement(spark, tables, name):
    got, want = catalogue.QUERIES[name](spark, FOLDER).toPandas(), tables.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
