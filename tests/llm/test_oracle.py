"""Training-data queries against their SQL on the smallest tables."""

import pytest

from lodestrata.llm.queries import ORACLE, QUERIES
from tests.test_oracle import duck, rows  # noqa: F401  a fixture


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, small, duck, name):  # noqa: F811
    got, want = QUERIES[name](spark, small), duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() >= 0
