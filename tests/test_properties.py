"""Properties on the driver-derived fixture, and a hot-key input."""

from pyspark.sql import functions as F

from sellerlens import catalog
from sellerlens import names as N
from sellerlens.operators import income as I
from sellerlens.operators import reports as R
from tests.conftest import SF_SMALL, rows


def test_month_totals_bound_their_parts(spark):
    for month, total, canceled, completed in rows(catalog.QUERIES["orders_by_month"](spark, SF_SMALL)):
        assert total >= canceled and total >= completed


def test_monthly_sku_sums_to_summary(spark):
    monthly = catalog.QUERIES["sku_monthly"](spark, SF_SMALL)
    by_cat = {r[0]: (r[1], r[2]) for r in rows(
        monthly.groupBy(N.PRODUCT_KIND).agg(F.sum(N.TOTAL_QUANTITY), F.sum(N.COMPLETED_ORDERS)))}
    summary = {r[0]: (r[1], r[2]) for r in rows(catalog.QUERIES["sku_summary"](spark, SF_SMALL))}
    assert by_cat == summary


def test_shares_sum_to_one(spark):
    shares = rows(catalog.QUERIES["sku_share"](spark, SF_SMALL), "share")
    assert abs(sum(s for (s,) in shares) - 1.0) < 1e-12


def test_cleaning_twice_equals_once(spark):
    from sellerlens.operators.cleaning import clean_orders
    once = catalog.QUERIES["clean_orders"](spark, SF_SMALL)
    cols = [c for c in once.columns if c not in (N.SKU_CATEGORY, N.CREATED_TS, N.ORDER_MONTH)]
    twice = clean_orders(once.select(*[N.c(c) for c in cols]))
    # Only provinces may change: a typo target (" Bình Thuận" strips to a
    # dictionary key) or a prefix that a leading space blocked the first time.
    from sellerlens.functions import mapping as M
    prefixes = M.PROVINCE_PREFIX_PASS_1 + M.PROVINCE_PREFIX_PASS_2
    changed = twice.select(*[N.c(c) for c in once.columns]).exceptAll(once)
    allowed = N.c(N.PROVINCE).isin("Bình Thuận", "hải Phòng")
    for p in prefixes:
        allowed = allowed | N.c("_before").startswith(p)
    once_p = once.select(N.c(N.ORDER_ID).alias("_id"), N.c(N.PROVINCE).alias("_before")).distinct()
    bad = changed.join(once_p, N.c(N.ORDER_ID) == F.col("_id")).where(~allowed)
    assert bad.isEmpty()
    non_province = [c for c in once.columns if c != N.PROVINCE]
    assert twice.select(*[N.c(c) for c in non_province]).exceptAll(
        once.select(*[N.c(c) for c in non_province])).isEmpty()


def test_join_report_equals_plain_join(spark):
    """The pre-aggregated join report equals aggregating the full fan-out."""
    t = catalog.tables(spark, SF_SMALL)
    fast = rows(R.region_analysis(t.orders, t.income))
    j = t.orders.join(t.income, t.orders[N.ORDER_ID] == t.income[N.RELATED_ORDER_ID])
    slow = (j.groupBy(N.c(N.PROVINCE).alias(N.PROVINCE))
             .agg(F.countDistinct(N.c(N.ORDER_ID)).alias("n"),
                  F.sum(N.c(N.TOTAL_REVENUE)).alias("rev"),
                  F.avg(F.when(N.c(N.RETURN_TYPE) == "Return/Refund", 1).otherwise(0)).alias("rate")))
    got = {r[0]: r[1:] for r in fast}
    for prov, n, rev, rate in rows(slow):
        assert got[prov][0] == n and abs(got[prov][1] - rev) < 1e-4 and abs(got[prov][2] - rate) < 1e-12


def test_hot_related_id(spark):
    """A third of all entries on one related ID (and many null IDs)."""
    hot = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT"))
         .when(F.col("id") % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("id").cast("string")).alias(N.RELATED_ORDER_ID),
        F.when(F.col("id") % 300 == 0, F.concat(F.lit("7"), F.col("id").cast("string")))
         .otherwise(F.concat(F.lit("a"), F.col("id").cast("string"))).alias(N.ADJUSTMENT_ID),
        F.lit("Order").alias(N.TYPE), F.lit(1.0).alias(N.TOTAL_REVENUE),
        F.lit(-0.1).alias(N.TOTAL_FEES), F.lit(0.9).alias(N.SETTLEMENT),
        F.lit("2024/01/01").alias(N.SETTLED_TIME))
    out = I.classify_income(hot)
    counts = dict(rows(out.groupBy(N.ORDER_TYPE).count()))
    n_hot = 10000
    n_null = len([i for i in range(30000) if i % 3 != 0 and i % 7 == 0])
    # HOT has adjustment IDs starting with 7 -> Compensation; the null group is
    # one group of n_null entries -> DoublePaid; the rest are single entries
    assert counts == {"Compensation": n_hot, "DoublePaid": n_null, "Normal": 30000 - n_hot - n_null}
    sizes = rows(out.where(N.c(N.RELATED_ORDER_ID).isNull()).select(N.CLASSIFY).distinct())
    assert sizes == [("Duplicate",)]
