"""Every registered query with SQL gives the SQL's rows at the smallest scale."""

import datetime
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from trailhead.plans import checks, graph, search, telemetry  # noqa: F401
from trailhead.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, (float, np.floating)) and np.isnan(v):
        return "~"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        return str(int(v)) if float(v).is_integer() else format(float(v), ".9g")
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(map(cell, r)) for r in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLE[name]).df())


def test_queries_without_sql_run(spark):
    for name in sorted(set(QUERIES) - set(ORACLE)):
        assert QUERIES[name](spark, SF).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(ORACLE) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    assert os.path.exists(SF)
