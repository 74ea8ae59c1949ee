"""Every query of the subpackage on the smallest tables; against SQL where there is any."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from millrace.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["doc_id", "line_no"], "p2_found": ["doc_id"], "p3_found": ["doc_id", "lang"], "p5_found": ["rec_table", "rec_id"], "p6_found": ["source", "line_id"],
    "p7_found": ["rec_table", "id_lo", "id_hi"], "p10_found": ["doc_id", "start_pos", "kind"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert len(got)
    if name in COLUMNS:
        assert list(got.columns) == COLUMNS[name] and not got.duplicated().any()
    if name in queries.SQL:
        con = duckdb.connect()
        for f in glob.glob(f"{FOLDER}/*.parquet"):
            con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        want = con.sql(queries.SQL[name]).df()
        shape = lambda d: d[sorted(d.columns)].astype(str).sort_values(sorted(d.columns)).reset_index(drop=True)
        pd.testing.assert_frame_equal(shape(got), shape(want))


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(entry.__file__)
    for f in glob.glob(f"{root}/millrace/**/*.py", recursive=True):
        if "/llm/" not in f:
            assert "llm" not in "".join(x for x in open(f).read().split("\n") if "import" in x), f
