"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as contract
from checks.compare import differences, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_result_as_sql(spark, con, name):
    df = contract.queries()[name](spark, SF)
    assert differences(df, contract.oracle_sql()[name], con) == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 3
