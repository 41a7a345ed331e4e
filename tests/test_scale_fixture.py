"""The derived tables are built with narrow shuffles."""

from sellerlens.sources import fixtures
from tests.conftest import SF_SMALL, rows


def test_order_lines_are_merged_narrow_and_not_shuffled_afterwards(spark):
    plan = fixtures.fixture_orders(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [l_orderkey" in plan
    above = plan[:plan.index("SortMergeJoin")]
    assert "Exchange" not in above
    written = spark.read.parquet(fixtures.materialize(spark, SF_SMALL).orders)
    assert sorted(map(str, rows(written))) == sorted(map(str, rows(fixtures.fixture_orders(spark, SF_SMALL))))
