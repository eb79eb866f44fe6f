import pytest
from oracle import connect, differences

import __spark_entry__ as entry_point
from tillview.catalog.oracles import ORACLES
from tillview.catalog.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    with connect(SF_DIR) as connection:
        yield connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert differences(con, ORACLES[name], QUERIES[name](spark, SF_DIR)) == []


def test_entry(spark):
    assert entry_point.entry(spark).count() == 80
