"""Every registered query against its DuckDB statement at the smallest scale."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from conftest import SF

import __spark_entry__ as entry

QUERIES = {name: query for name, query in entry.queries().items() if name in entry._QUERIES}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in entry._QUERIES}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return connection


def _rows(frame: pd.DataFrame) -> list[str]:
    columns = sorted(frame.columns)

    def value(v):
        return None if pd.isna(v) else v if isinstance(v, str) else round(float(v), 6)

    return sorted(str([value(v) for v in row]) for row in frame[columns].itertuples(index=False, name=None))


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_statement(spark, duck, name):
    got, expected = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) > 0
    assert _rows(got) == _rows(expected)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
