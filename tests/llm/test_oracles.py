import pytest

from lodestone.llm.queries import ORACLES, QUERIES
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name])
