"""Every query against its SQL form, and plan shapes, at the smallest scale."""

import os
import re

import pytest

import __spark_entry__ as contract
import oracle
from faintline.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_DIR)


# queries of optional packages are tested beside those packages
@pytest.mark.parametrize("name", list(registry.ALL))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    sql = contract.oracle_sql().get(name)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    if sql is None:
        assert df.count() > 0
    else:
        assert oracle.differences(df, duck, sql) == []


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["pred_category", "n_obs"]
    assert sum(r.n_obs for r in df.collect()) == 500


def test_filters_reach_the_scan(spark):
    for name, pushed in {
        "B07_equality": "DataFilters: [(concat(E, cast(user_id",
        "B11_year": "GreaterThanOrEqual(l_shipdate",
        "B12_time_range": "GreaterThan(ts",
        "B08_between": "GreaterThanOrEqual(vec_id",
    }.items():
        plan = contract.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan, name


def test_narrow_scan(spark):
    plan = contract.queries()["D13_distinct"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint>" in plan


def test_flagship_shuffles_counts_only(spark):
    plan = contract.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count" in plan
