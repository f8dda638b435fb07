"""The problems' queries against their SQL on small tables."""

import glob
import os

import duckdb
import pytest

from corpusmill.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(set(SQL) - {"p6_round_trip"}))
def test_query_is_its_sql(spark, name):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.sql(SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))
