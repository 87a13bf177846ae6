"""Every query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from assayframe.plans import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [tuple(None if pd.isna(x) else round(float(x), 6) if isinstance(x, float) and x != int(x) else int(x) if isinstance(x, float) else x for x in r) for r in df.astype(object).itertuples(index=False)]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = _plain(got.toPandas()), _plain(want.df())
    assert a, "a query that finds nothing shows nothing"
    assert len(a) == len(b)
    assert [tuple(map(str, r)) for r in a] == [tuple(map(str, r)) for r in b]


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)
