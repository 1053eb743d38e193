"""Every market query with SQL gives DuckDB's rows on the smallest tables."""

import pytest

from tests.compare import duck, same
from tideframe.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, con, name):
    same(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
