"""Every query outside the optional subpackage against its SQL."""

import pytest
from parity import compare, connect

from tessera.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, con, name):
    compare(catalog.QUERIES[name](spark, SF), con, catalog.ORACLE_SQL[name])


def test_sketch_is_near(spark):
    """Within three of the standard errors that the query asks for."""
    row = catalog.QUERIES["approx_distinct"](spark, SF).first()
    assert abs(row["about"] - row["exact"]) <= 3 * 0.02 * row["exact"]


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
