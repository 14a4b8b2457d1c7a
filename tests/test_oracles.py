"""Every core query with SQL against DuckDB, over whole tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from graphlens.plans import registry


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        f = float(v)
        return str(int(f)) if f == int(f) else f"{f:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(sf_dir + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted("|".join(plain(r[c]) for c in columns) for r in df.collect())
    rel = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted("|".join(plain(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert registry.queries()[name](spark, "/root/testdata/sf0.01").count() > 0
