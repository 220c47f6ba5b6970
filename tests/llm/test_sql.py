"""Queries of the text operators that SQL can express, against DuckDB."""

import duckdb
import pytest

from glossmill.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    answer = con.sql(queries.oracle_sql()[name])
    names = sorted(df.columns)
    at = [answer.columns.index(c) for c in names]
    got = sorted(repr([r[c] for c in names]) for r in df.collect())
    assert got == sorted(repr([r[i] for i in at]) for r in answer.fetchall()) and got
