"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def rows(columns, values):
    """Rows as text, columns by name, in a fixed order; whole numbers and fractions stay apart."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(v[i]) for i in order) for v in values)


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, db, name):
    frame = entry.queries()[name](spark, DATA)
    ours = rows(frame.columns, frame.collect())
    found = db.execute(entry.oracle_sql()[name])
    assert ours[1] and ours == rows([c[0] for c in found.description], found.fetchall())
