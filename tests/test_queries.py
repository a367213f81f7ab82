"""Every query with SQL against that SQL, on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from lariat.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def tables(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    try:
        return round(float(v), 6) + 0.0
    except (TypeError, ValueError):
        return str(v)[:19] if hasattr(v, "year") else str(v)


def rows(columns, values):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted((tuple(plain(r[i]) for i in at) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, tables, name):
    df = registry.queries()[name](spark, sf_dir)
    want = tables.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


def test_all_can_be_listed_without_a_session():
    assert len(registry.queries()) > 300 and set(SQL) <= set(registry.queries())
