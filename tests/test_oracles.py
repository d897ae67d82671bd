"""Every query against its SQL on the small tables."""

import pytest

import __spark_entry__ as entry_points
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, connection):
    frame = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert difference(frame, connection, ORACLES[name]) is None
    else:
        assert frame.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1500
