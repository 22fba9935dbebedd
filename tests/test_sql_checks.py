"""Every query that has a SQL twin gives the same rows as DuckDB; the others give rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from tests.conftest import SMALL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def text(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


def rows_of(records, columns, order):
    at = [columns.index(c) for c in order]
    return sorted(tuple(text(r[i]) for i in at) for r in records)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    got = entry_points.queries()[name](spark, SMALL)
    want = duck.execute(entry_points.oracle_sql()[name])
    want_columns = [d[0] for d in want.description]
    order = sorted(got.columns)
    assert order == sorted(want_columns)
    assert rows_of(got.collect(), got.columns, order) == rows_of(want.fetchall(), want_columns, order)


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) - set(entry_points.oracle_sql())))
def test_gives_rows(spark, name):
    assert entry_points.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    answer = entry_points.entry(spark)
    assert answer.columns[:3] == ["finding_id", "source", "severity"]
    assert {r.severity for r in answer.collect()} == {"high"}
