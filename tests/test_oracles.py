"""Every registered query of the library against its DuckDB oracle, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from memspark.plans import registered

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    cell = lambda x: "NULL" if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else repr(float(x)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_oracle(spark, duck, name):
    got, want = registered.QUERIES[name](spark, DATA).toPandas(), duck.execute(registered.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registered.QUERIES) <= set(__spark_entry__.queries())
