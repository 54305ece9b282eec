"""The training-data queries that SQL can express against their DuckDB twins, on the smallest tables."""

import pytest

from tallywright.llm import registry

from tests.compare import TESTDATA, connection, differences

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_oracle(spark, duck, name):
    assert differences(registry.QUERIES[name](spark, SF), duck, registry.ORACLE[name]) == ""
