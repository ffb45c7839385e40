"""Every registered query against its SQL, at a small scale."""

import numbers

import duckdb
import numpy as np
import pandas as pd
import pytest

from strataloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Their SQL is slow: run by hand.
SLOW = {"near_duplicate_pairs", "benchmark_contamination"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(df):
    one = lambda v: None if pd.isna(v) else float(v) if isinstance(v, numbers.Number) and not isinstance(v, (bool, np.bool_)) else str(v)
    return sorted((tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL.keys() - SLOW))
def test_query_matches_sql(spark, sf, duck, name):
    assert rows(catalog.QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(catalog.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLE_SQL.keys()))
def test_other_queries_run(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
