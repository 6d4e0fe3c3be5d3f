import pytest

import __spark_entry__ as contract
from workload.check import difference, sql_frame

SF = "/root/testdata/sf0.001"
SLOW = {"rec7_recommend", "rec10_performance_all"}


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, name):
    got = contract.queries()[name](spark, SF).toPandas()
    assert difference(got, sql_frame(SF, contract.oracle_sql()[name])) == ""


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql()) - SLOW))
def test_query_returns_rows(spark, name):
    assert contract.queries()[name](spark, SF).count() > 0
