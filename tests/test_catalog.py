"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from lectern.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def clean(v):
    if not isinstance(v, (list, tuple, np.ndarray)) and pd.isna(v):
        return "None"
    return str(round(float(v), 6)) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)


def rows(frame):
    return sorted(tuple(map(clean, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    mine, theirs = catalog.queries()[name](spark, FOLDER).toPandas(), duck.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert len(mine) == len(theirs)
    for a, b in zip(rows(mine), rows(theirs), strict=True):
        for x, y in zip(a, b, strict=True):
            try:
                assert x == y or abs(float(x) - float(y)) < 2e-6
            except ValueError:
                assert x == y, (a, b)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0
