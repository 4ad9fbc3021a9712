"""Every map query with SQL gives what DuckDB gives on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from cartospark import queries as maps

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "None" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(maps.SQL))
def test_same_as_sql(spark, duck, name):
    pd.testing.assert_frame_equal(normal(maps.QUERIES[name](spark, SF).toPandas()), normal(duck.sql(maps.SQL[name]).df()))


@pytest.mark.parametrize("name", sorted(set(maps.QUERIES) - set(maps.SQL)))
def test_rows_without_sql(spark, name):
    """Their values are checked on small networks; here they have rows."""
    assert maps.QUERIES[name](spark, SF).take(1)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
