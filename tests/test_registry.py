"""Registered queries against their SQL on the smallest tables (ALL_QUERIES=1 runs those that fit models too)."""

import os
import re

import pytest
from oracle import connect, differences

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
# these fit models for minutes; test_features_and_models.py covers their parts
SLOW = {"train_market_models", "train_boosted", "tune_boosted", "train_model_family", "train_valuation_models",
        "benchmark_models", "batch_predict", "batch_valuation", "model_metadata", "valuation_sanity"}
NAMES = sorted(n for n in entry.oracle_sql() if not re.match(r"op\d+_", n) and (os.environ.get("ALL_QUERIES") or n not in SLOW))


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    assert differences(spark, duck, entry.queries()[name], entry.oracle_sql()[name], SF_DIR) == []


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    from estatelake.sources.files import scan_training_rows
    from estatelake.sources.sample import table
    from pyspark.sql import functions as F

    rows = table(spark, SF_DIR, "lineitem").select(F.col("l_extendedprice").alias("price_egp"), F.col("l_returnflag").alias("offering_type"))
    plan = plan_of(scan_training_rows(rows))
    assert "GreaterThan(l_extendedprice,0.0)" in plan and "ReadSchema: struct<l_extendedprice:double,l_returnflag:string>" in plan


def test_plans_hold_no_cross_join_and_limit_groups_early(spark):
    for name in ("p99_trim", "log_price_histogram", "vw_market_opportunity_signals", "duplicate_statistics", "transform_listings"):
        plan = plan_of(entry.queries()[name](spark, SF_DIR))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan
    assert "TakeOrderedAndProject" in plan_of(entry.queries()["search_listings"](spark, SF_DIR))
