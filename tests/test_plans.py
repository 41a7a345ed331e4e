"""Plan tests: what Spark runs, not just what it returns."""

import pytest

import __spark_entry__ as E
from sellerlens import catalog
from sellerlens.operators import cleaning
from sellerlens.sources import fixtures
from tests.conftest import SF_SMALL


def physical(spark, df, mode="formatted"):
    jvm = spark._jvm
    return df._jdf.queryExecution().explainString(
        jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def q(spark, name):
    return catalog.QUERIES[name](spark, SF_SMALL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_python_in_any_plan(spark, name):
    plan = physical(spark, q(spark, name))
    for op in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
               "PythonUDF", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert op not in plan, f"{name} uses {op}"


def test_cleaning_is_one_narrow_stage(spark):
    raw = spark.read.parquet(fixtures.materialize(spark, SF_SMALL).orders)
    plan = physical(spark, cleaning.clean_orders(raw))
    assert "Exchange" not in plan and "Sort" not in plan
    assert "WholeStageCodegen" in plan or "*" in plan


def test_top_k_is_take_ordered(spark):
    for name in ("top_buyers", "top_provinces"):
        assert "TakeOrderedAndProject" in physical(spark, q(spark, name))


def test_aggregations_combine_before_shuffle(spark):
    for name in ("orders_by_month", "region_analysis", "classify_income", "top_buyers"):
        plan = physical(spark, q(spark, name))
        assert "partial_" in plan, name


def test_labels_pruned_when_unused(spark):
    for name in ("income_by_month", "scan_income"):
        assert "Join" not in optimized(q(spark, name)), name
    # and the entries are scanned once
    plan = q(spark, "income_by_month")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    # the join reports keep only the per-order join
    assert optimized(q(spark, "top_buyers")).count("Join ") == 1


def test_join_reports_do_not_join_raw_rows(spark):
    """Q6/Q7/Q9/Q10 join one row per (key, order) to one row per order."""
    plan = optimized(q(spark, "region_analysis"))
    assert plan.count("Join ") == 1
    assert plan.count("Aggregate [") >= 3


def test_filters_and_columns_reach_the_scan(spark):
    top = physical(spark, q(spark, "top_buyers"))
    assert "EqualTo(`Order Status`,Completed)" in top
    assert "ReadSchema: struct<Order ID:string,Order Status:string,Buyer Username:string>" in top
    sku = physical(spark, q(spark, "find_sku"))
    assert "EqualTo(`SKU ID`,558)" in sku
    order = physical(spark, q(spark, "find_order"))
    # the one-order search classifies only that order's entries: every scan is filtered
    assert order.count("EqualTo(`Related order ID`,500000000000000143)") >= 3
    summary = physical(spark, q(spark, "sku_summary"))
    assert "ReadSchema: struct<Order Status:string,Seller SKU:string,Quantity:double>" in summary


def test_share_uses_scalar_subquery_not_join(spark):
    plan = optimized(q(spark, "sku_share"))
    assert "scalar-subquery" in plan and "Join" not in plan


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["Order_Month", "Số đơn hàng", "Số đơn huỷ", "Số đơn thành công"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) <= set(E.oracle_sql())


def _counts(spark, name):
    """(hash exchanges, scans, joins) of the plan without broadcasts."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = q(spark, name)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    return (plan.count("Exchange hashpartitioning"), plan.count("FileScan parquet"),
            plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin"))


@pytest.mark.parametrize("name, most", [
    ("order_type", (3, 2, 1)), ("group_any", (3, 2, 1)), ("adjustments", (2, 2, 1)),
    ("find_city", (2, 2, 1)), ("find_sku", (2, 2, 1)), ("find_buyer", (2, 2, 1)), ("match_counts", (99, 8, 4))])
def test_plans_stay_small_without_broadcast(spark, name, most):
    assert all(a <= b for a, b in zip(_counts(spark, name), most)), _counts(spark, name)


def test_classification_reuses_the_pair_shuffle(spark):
    """Two scans of the entries and one shuffle of the pairs, used twice."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        plan = q(spark, "classify_income").select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("FileScan parquet") == 2 and plan.count("ReusedExchange") == 1, plan
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 4
