"""Every registered query against its SQL on the smallest data set."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registry
from orderwatch.plans import QUERIES


@pytest.fixture(scope="module")
def base(star_folder):
    connection = duckdb.connect()
    for path in Path(star_folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def normal(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)):
        return repr(round(float(value), 9) + 0.0)
    return str(value)


def comparable(columns, table):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in table)


def test_every_query_has_sql():
    """All but text preparation, whose learned and hashed operators SQL cannot express: they have tests of their own."""
    assert set(QUERIES) <= set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, base, star_folder, name):
    df = registry.queries()[name](spark, star_folder)
    result = base.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert comparable(df.columns, [tuple(r) for r in df.collect()]) == comparable(columns, result.fetchall())


def test_entry(spark):
    assert registry.entry(spark).count() > 0
