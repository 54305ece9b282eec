"""Every core query against its DuckDB twin, on the smallest tables."""

import pytest

from tallywright.plans import registry

from .compare import TESTDATA, connection, differences

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_oracle(spark, duck, name):
    assert differences(registry.QUERIES[name](spark, SF), duck, registry.ORACLE[name]) == ""


def test_every_query_has_an_oracle_or_says_why():
    assert set(registry.QUERIES) - set(registry.ORACLE) == set()
