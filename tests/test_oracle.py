"""Every query of the library with SQL gives the rows that DuckDB gives on the same tables."""

import datetime
import math
import os

import duckdb
import numpy as np
import pytest

from glossmill.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (np.ndarray, list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return round(float(v), 6) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    answer = con.sql(registry.oracle_sql()[name])
    assert sorted(answer.columns) == names
    at = [answer.columns.index(c) for c in names]
    want = [tuple(plain(r[i]) for i in at) for r in answer.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) or sorted(got, key=repr) == pytest.approx(sorted(want, key=repr))
    assert got


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.columns and df.collect()
