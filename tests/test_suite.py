"""Every named query against its SQL in DuckDB."""

import math

import duckdb
import pandas as pd
import pytest

from rdfloom import suite

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return float(f"{float(v):.9g}") if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


def rows(df):
    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(suite.queries()))
def test_query(spark, duck, name):
    got, want = suite.queries()[name](spark, SF).toPandas(), duck.sql(suite.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
