"""Each query against its SQL on the same tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from evograph import catalog

SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[tuple]:
    one = lambda v: "null" if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)
    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    return con


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    a, b = catalog.queries()[name](spark, SF).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
