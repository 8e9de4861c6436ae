"""Every registered query against its oracle, and what its plan may not contain."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    frame = QUERIES[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name in ORACLES:
        assert compare(connection, frame, ORACLES[name]) is None
    else:
        assert frame.count() > 0


def test_entry(spark):
    frame = entry(spark)
    assert frame.count() > 0
    assert frame.columns == ["unit", "code", "yr", "v"]
