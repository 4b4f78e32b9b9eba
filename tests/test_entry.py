"""The driver's contract, and every registered query with SQL against DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from nearweave.queries import ORACLE_SQL, QUERIES

SLOW = {"forest_converged_invariants", "descent_converged_invariants"}


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(r[i], 5) if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 5000


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLE_SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert canonical(got.collect(), got.columns) == canonical(want.fetchall(), columns)
