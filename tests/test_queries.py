"""Every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from millrace.plans import queries as core

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def shape(df: pd.DataFrame) -> pd.DataFrame:
    return df[sorted(df.columns)].astype(str).sort_values(sorted(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = duck.sql(core.SQL[name]).df()
    pd.testing.assert_frame_equal(shape(got), shape(want))


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    assert df.count() == len(df.toPandas()) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
