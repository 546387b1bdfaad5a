"""The queries that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

from cellspark.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted((tuple(r) for r in got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_every_query_reads_its_whole_table(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    for name, f in queries.QUERIES.items():
        table = {"op5_warc": "pages", "op12_shallot": "embeddings"}.get(name, "documents")
        out = f(spark, DATA)
        n = spark.read.parquet(f"{DATA}/{table}.parquet").count()
        assert out.count() >= n if name == "op9_packing" else out.count() == n, name
