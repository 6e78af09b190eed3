"""Every query with SQL against DuckDB over the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from pointloom.plans import queries


def rows(df):
    cols = sorted(df.columns)
    plain = lambda v: v.tolist() if isinstance(v, np.ndarray) else v
    return sorted(repr([plain(v) for v in r]) for r in df[cols].astype(object).where(df[cols].notna(), None).values.tolist())


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.sql(f"create view {t.split('.')[0]} as select * from '{sf_dir}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, sf_dir, duck, name):
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
