"""Queries that SQL can express, against their statements."""

import pytest

from compare import connect, difference
from tidewatch.llm.queries import CHECKS, QUERIES


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, folder, name):
    assert difference(spark, connect(folder), folder, QUERIES[name], CHECKS[name]) is None
