"""Every query with SQL gives DuckDB's rows."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from corpusweave.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return f"{float(v):.9g}"
    if isinstance(v, (float, np.floating)):
        return f"{float(v):.9g}"
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False))


def alike(a, b):
    if a == b:
        return True
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-7, abs_tol=1e-9)
    except ValueError:
        return False


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert all(alike(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
