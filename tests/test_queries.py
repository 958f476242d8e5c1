"""Every query against its SQL on the smallest tables; without SQL it must give rows."""

import math

import duckdb
import pytest
from millwright.plans import catalog, shapes, studies

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


def place(row):
    """Sort key: what is exact first, then rounded floats."""
    return repr([x for x in row if not isinstance(x, float)]), repr([round(x, 4) + 0.0 for x in row if isinstance(x, float)])


def near(x, y):
    """Equal, or floats that differ by no more than their rounding: a unit of the last digit that queries keep where
    sums come in another order (1e-9 of the value, 1e-9 at least)."""
    return x == y or isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(x[i]) for i in order) for x in data), key=place)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


QUERIES = catalog.queries() | studies.queries() | shapes.queries()
SQL = catalog.oracle_sql() | studies.oracle_sql() | shapes.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in SQL:
        assert got
        return
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    want = rows(columns, found.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        assert all(near(x, y) for x, y in zip(a, b)), (a, b)
