"""Every registered query runs; those with SQL agree with a plain SQL engine."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def canonical(df):
    columns = sorted(df.columns)

    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
            return "NULL"
        if isinstance(v, (float, np.floating)):
            return format(v + 0.0, ".9g")
        return str(v)

    out = pd.DataFrame({c: df[c].map(cell) for c in columns})
    return out.sort_values(columns).reset_index(drop=True)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sql, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = sql.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    pd.testing.assert_frame_equal(canonical(got), canonical(want))


@pytest.mark.parametrize("name", ["scorecard", "ridge_stack", "out_of_fold", "hierarchy", "campaign_evidence"])
def test_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 3
