"""Corpus queries that SQL can express, against it."""

import duckdb
import pytest
from millwright.llm import catalog

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(want, key=repr) != []
