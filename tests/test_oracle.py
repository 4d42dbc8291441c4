"""Every registered query of the engine against its SQL in DuckDB, values and types."""

import os

import duckdb
import pandas as pd
import pytest

from sievework.plans import catalogue, operations

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(df: pd.DataFrame, columns: list[str]) -> list[tuple]:
    def plain(v):
        return "" if v is None or pd.isna(v) else f"{v:.6f}" if isinstance(v, float) and v != int(v) else str(v).removesuffix(".0")

    return sorted(tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False))


QUERIES, SQL = catalogue.queries() | operations.queries(), catalogue.oracle_sql() | operations.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert {c: TYPES[t] for c, t in got.dtypes} == dict(zip(want.columns, map(str, want.types)))
    columns = sorted(got.columns)
    a, b = rows(got.toPandas(), columns), rows(want.df(), columns)
    assert a == b and a


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == catalogue.TOP
