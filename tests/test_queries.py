"""Each registered query against its SQL on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from codelathe.plans import analysis, catalog, flows, javacode, lookups, queries, sourcefiles  # noqa: F401
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toArrow()
    want = duck.execute(catalog.ORACLES[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    rows = lambda t: sorted(repr(tuple(map(plain, r))) for r in zip(*(t[c].to_pylist() for c in columns)))
    assert rows(got) == rows(want)


def test_entry_imports():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(catalog.QUERIES) <= names
    assert set(__spark_entry__.oracle_sql()) <= names
