"""Every query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        if hasattr(x, "year"):
            return str(pd.Timestamp(x))
        return repr(float(x) + 0.0) if isinstance(x, float) else str(x)

    return sorted((tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["c2_target_view", "t9_a23_a24_datasets", "e4_continuous_allocation", "e5_probabilistic"])
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0
