"""Every registered query with a second-engine text gives the same rows there."""

import pytest

from lattica import registry

from . import oracle


@pytest.fixture(scope="module")
def duck(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, data, duck, name):
    columns, rows = oracle.spark_rows(registry.QUERIES[name](spark, data))
    assert (columns, rows) == oracle.duck_rows(duck, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).columns
