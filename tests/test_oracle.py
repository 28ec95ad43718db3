"""Every registered query against its DuckDB oracle on the smallest data."""

import pytest

from scholarmatch.plans import all_oracles, all_queries
from tests.oracle import duck, run_pair

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, con, name):
    ok, note, _ = run_pair(spark, SF, QUERIES[name], ORACLES.get(name), con)
    assert ok, note


def test_every_query_has_its_oracle():
    assert set(ORACLES) == set(QUERIES)
