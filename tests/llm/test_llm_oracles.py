"""The corpus queries that have SQL: the same rows from Spark and from DuckDB; the others give a row per row of their table."""

import os

import pytest
from tidemark.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_a_row_for_each_row(spark, name):
    source = "pages" if name.startswith(("op7_", "op10_")) else "documents"
    assert QUERIES[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{source}.parquet").count()
