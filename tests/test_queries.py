import pytest
from oracle import compare

import __spark_entry__ as entry
from tidewell.plans import registered

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registered.oracle_sql))
def test_as_sql(spark, name):
    compare(spark, registered.queries[name], registered.oracle_sql[name], SF)


@pytest.mark.parametrize("name", sorted(set(registered.queries) - set(registered.oracle_sql)))
def test_without_sql(spark, name):
    assert registered.queries[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
