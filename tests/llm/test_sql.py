"""What SQL can express of the training-data operators equals what DuckDB gives."""

import duckdb
import pytest

from assayframe.llm import queries

SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    got, want = queries.queries()[name](spark, sf), duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda xs: sorted(tuple(map(str, x)) for x in xs)
    a = rows([[r[c] for c in columns] for r in got.collect()])
    assert a and a == rows(want.select(*[f'"{c}"' for c in columns]).fetchall())
