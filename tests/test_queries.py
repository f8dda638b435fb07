"""Every core query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from corpusmill.plans.catalog import QUERIES, SQL


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and np.isnan(x)):
        return "~"
    if isinstance(x, (float, np.floating)):
        return f"{round(float(x), 6):.6f}".rstrip("0").rstrip(".")
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(cell(y) for y in x) + "]"
    return str(int(x)) if isinstance(x, (int, np.integer)) and not isinstance(x, bool) else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        assert rows(got) == rows(con.sql(SQL[name]).df())
