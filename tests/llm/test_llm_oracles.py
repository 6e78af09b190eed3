"""Queries with SQL against DuckDB over the smallest tables."""

import os

import duckdb
import pytest

from pointloom.llm import queries


def rows(df):
    cols = sorted(df.columns)
    whole = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v  # noqa: E731  a long beside nulls may come as a float
    return sorted(repr([whole(v) for v in r]) for r in df[cols].astype(object).where(df[cols].notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.sql(f"create view {t.split('.')[0]} as select * from '{sf_dir}/{t}'")
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
