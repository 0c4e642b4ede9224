"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__
from convolens.plans import dialogues, evaluations, extras, proxies, regrades, reports  # noqa: F401
from conftest import DATA, compare


@pytest.mark.parametrize("name", sorted(proxies.ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    compare(proxies.QUERIES[name](spark, DATA), duck, proxies.ORACLE_SQL[name])


def test_entry_has_rows_and_names_match(spark):
    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    df = proxies.QUERIES["constraint_query_gt"](spark, DATA).select("c_custkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(c_acctbal" in plan
    assert "c_name" not in plan.split("ReadSchema")[1]
