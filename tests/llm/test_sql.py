"""Operators that SQL can express give the same rows in DuckDB."""

import duckdb
import pytest

from ragmill.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "embeddings"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    wanted = connection.sql(queries.ORACLES[name]).df()
    found = queries.QUERIES[name](spark, FOLDER).toPandas()
    assert sorted(found.columns) == sorted(wanted.columns)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert rows(found) == rows(wanted)
