"""Every engine query against its SQL, on the small star-schema tables."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from rasterloom.plans.registry import oracle_sql, queries

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", list(queries()))
def test_query_equals_sql(spark, sql, name):
    df = queries()[name](spark, SF)
    own = rows(df.columns, df.collect())
    found = sql.sql(oracle_sql()[name])
    assert own == rows(list(found.columns), found.fetchall())


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())
