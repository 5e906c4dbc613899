"""Every registered query against its DuckDB SQL on the given tables."""

import pytest
from oracle_check import differences

import __spark_entry__ as entry_point
from tallyroute.plans.oracle import ORACLE_SQL
from tallyroute.plans.queries import QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas"):
        assert operator not in plan
    assert differences(sf_dir, name, df) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) <= set(entry_point.oracle_sql())
    assert set(QUERIES) <= set(entry_point.queries())


def test_entry_runs(spark):
    assert entry_point.entry(spark).count() == 418


def test_footer_counts_read_no_column(spark, sf_dir):
    df = QUERIES["dataset_row_counts_footers"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedAggregation: [COUNT(*)]") == 14
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, QUERIES["dataset_row_counts"](spark, sf_dir).collect()))
