"""The queries that SQL can express, against DuckDB on whole tables."""

import duckdb
import pytest

from tidemill.llm import queries as q

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "benchmark", "embeddings"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df, relation = q.queries()[name](spark, SF), con.sql(q.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert mine == sorted(relation.select(*columns).fetchall(), key=str)
