"""Every query against its SQL on the smallest tables, and the entry point."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from prismfeed.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return None
    return float(f"{float(v):.9g}") if isinstance(v, (float, int, np.number)) and not isinstance(v, bool) else str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(plain(r[k]) for k in names) for r in frame.to_dict("records")), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert rows(got) == rows(duck.sql(ORACLES[name]).df())
    assert len(got) or name == "set_except_breaking"


@pytest.mark.parametrize("name", sorted({*QUERIES} - {*ORACLES}))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and {*entry.oracle_sql()} <= {*entry.queries()}
