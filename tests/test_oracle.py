"""Every query with an oracle against DuckDB on the smallest tables."""

import decimal
import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canonical(frame):
    def cell(x):
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        if pd.isna(x):
            return "-"
        return str(round(float(x), 5) + 0.0) if isinstance(x, (int, float, np.number, decimal.Decimal)) else str(x)

    return sorted(tuple(cell(x) for x in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_contract(spark):
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() >= 0
