"""Every registered query against its DuckDB oracle (the driver's check)."""

import pytest

import __spark_entry__ as E
from carelake.plans import registry
from conftest import SF_SMALL
from oracle_harness import compare, duck

ORACLE = E.oracle_sql()
#: the library's own queries; those of optional parts are tested beside them
QUERIES = {k: v for k, v in E.queries().items() if k in registry.queries()}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    assert compare(QUERIES[name](spark, SF_SMALL), con, ORACLE[name]) == []


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["year", "months_observed", "observed_total", "projected_remaining", "year_projection"]
