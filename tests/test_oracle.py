"""Every core query against its SQL on the smallest tables, values and all."""

import glob
import math
import os
from decimal import Decimal

import pytest

from lodestrata import measures  # noqa: F401  adds its queries
from lodestrata.catalogue import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, Decimal)):
        return "None" if math.isnan(v) else f"{float(v):.6f}"
    return str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, small, duck, name):
    got = QUERIES[name](spark, small)
    want = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
