import pytest

from sluice.llm import queries
from tests import oracle


@pytest.mark.skipif(oracle.MISSING, reason="no test data here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    assert oracle.differ(spark, queries.QUERIES, queries.ORACLES, name) == ([], [], 0)
