"""Reports Q1 … Q12 over cleaned orders and classified income.

Conventions, kept in every report:

* sorts put nulls last in both directions and end with the group key as a
  tie-breaker, so results are deterministic;
* money and rates are summed exactly (``functions.exact``): a result is the
  true sum, rounded once, whatever the order and the partitioning;
* the join reports count and sum over the many-to-many join exactly as
  ``orders JOIN income`` would (an order with two entries counts twice),
  but are computed from per-order partial results (see ``plans.joins``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sellerlens import names as N
from sellerlens.functions.exact import exact_avg, exact_sum, exact_sum_of_lanes
from sellerlens.functions.text import money_text, sku_category
from sellerlens.plans.joins import Parts, joined_lines, order_income

c = N.c


def _is(col: str, value: str) -> Column:
    """``CASE WHEN col = value THEN 1 ELSE 0 END`` (null -> 0)."""
    return F.when(c(col) == F.lit(value), 1).otherwise(0)


def money_sum(col: str) -> Column:
    """Sum of money as DOUBLE, the same in any order of addition."""
    return exact_sum(c(col))


# ---------------------------------------------------------------- page load


def orders_by_month(orders: DataFrame) -> DataFrame:
    """Q1: distinct orders, canceled orders and completed orders per month.

    Two aggregation steps instead of three ``COUNT(DISTINCT)``: first one row
    per (month, order) with "any line canceled / completed" flags, then
    counts per month. Null order IDs are not counted, but their month still
    appears (with zeros).
    """
    per_order = (orders.groupBy(c(N.ORDER_MONTH).alias(N.ORDER_MONTH),
                                c(N.ORDER_ID).alias("_oid"))
                       .agg(F.max(_is(N.ORDER_STATUS, N.STATUS_CANCELED)).alias("_canceled"),
                            F.max(_is(N.ORDER_STATUS, N.STATUS_COMPLETED)).alias("_completed")))
    known = F.col("_oid").isNotNull()
    return (per_order.groupBy(N.ORDER_MONTH)
                     .agg(F.count("_oid").alias(N.N_ORDERS),
                          F.sum(F.when(known, F.col("_canceled")).otherwise(0)).alias(N.N_CANCELED),
                          F.sum(F.when(known, F.col("_completed")).otherwise(0)).alias(N.N_COMPLETED))
                     .orderBy(F.asc_nulls_last(N.ORDER_MONTH)))


def sku_summary(orders: DataFrame) -> DataFrame:
    """Q2: units per SKU category and number of *lines* of completed orders."""
    cat = c(N.SKU_CATEGORY)
    return (orders.where(cat.isNotNull())
                  .groupBy(cat.alias(N.SKU_CATEGORY))
                  .agg(F.sum(c(N.QUANTITY)).alias(N.SUM_QTY),
                       F.sum(_is(N.ORDER_STATUS, N.STATUS_COMPLETED)).alias(N.COMPLETED_LINES))
                  .orderBy(F.desc_nulls_last(c(N.SUM_QTY)), F.asc_nulls_last(c(N.SKU_CATEGORY))))


def sku_monthly(orders: DataFrame) -> DataFrame:
    """Q3: Q2 per (month, SKU category); month ascending, units descending."""
    cat = c(N.SKU_CATEGORY)
    return (orders.where(cat.isNotNull())
                  .groupBy(c(N.ORDER_MONTH).alias(N.MONTH_VN), cat.alias(N.PRODUCT_KIND))
                  .agg(F.sum(c(N.QUANTITY)).alias(N.TOTAL_QUANTITY),
                       F.sum(_is(N.ORDER_STATUS, N.STATUS_COMPLETED)).alias(N.COMPLETED_ORDERS))
                  .orderBy(F.asc_nulls_last(c(N.MONTH_VN)), F.desc_nulls_last(N.TOTAL_QUANTITY),
                           F.asc_nulls_last(c(N.PRODUCT_KIND))))


def income_by_month(income: DataFrame) -> DataFrame:
    """Q4: revenue and settlement per settle month."""
    month = F.date_format(c(N.SETTLED_TIME), "yyyy-MM")
    return (income.groupBy(month.alias(N.MONTH))
                  .agg(money_sum(N.TOTAL_REVENUE).alias(N.REVENUE),
                       money_sum(N.SETTLEMENT).alias(N.NET_REVENUE))
                  .orderBy(F.asc_nulls_last(N.MONTH)))


def income_by_month_text(income: DataFrame) -> DataFrame:
    """Q4 as displayed: month and both sums as money text (``1,234 ₫``)."""
    q = income_by_month(income)
    return q.select(N.MONTH,
                    money_text(c(N.REVENUE)).alias(N.REVENUE + N.FMT_SUFFIX),
                    money_text(c(N.NET_REVENUE)).alias(N.NET_REVENUE + N.FMT_SUFFIX))


def traffic_by_month(overview: DataFrame, lenient: bool = False) -> DataFrame:
    """Q5: page views and store visits summed, conversion averaged per month.

    The average is the plain mean of the daily rates (not weighted). The day is cast to DATE; a day text that
    is not a date fails the job, as the SQL cast does, unless ``lenient``
    (then it counts under a null month).
    """
    day = c(N.DAY).try_cast("date") if lenient else c(N.DAY).cast("date")
    month = F.date_format(day, "yyyy-MM")
    return (overview.groupBy(month.alias(N.MONTH_VN))
                    .agg(F.sum(c(N.PAGE_VIEWS)).alias(N.PAGE_VIEWS),
                         F.sum(c(N.STORE_VISITS)).alias(N.STORE_VISITS),
                         exact_avg(c(N.CONVERSION)).alias(N.CONVERSION))
                    .orderBy(F.asc_nulls_last(c(N.MONTH_VN))))


# ---------------------------------------------------------------- on demand


def top_by_joined_rows(orders: DataFrame, income: DataFrame, key: str, k: int = 10, more: Parts = ()) -> DataFrame:
    """Top ``k`` values of ``key`` among completed lines by *joined rows*
    (lines x entries), as ``COUNT("Order ID")`` over the join counts them."""
    where = (c(N.ORDER_STATUS) == F.lit(N.STATUS_COMPLETED)) & c(key).isNotNull()
    j = joined_lines([(orders, income), *more], [key], where=where)
    return (j.groupBy(c(key).alias(key))
             .agg(F.sum(F.col("n_lines") * F.col("n_inc")).alias(N.TOTAL_ORDERS))
             .orderBy(F.desc_nulls_last(c(N.TOTAL_ORDERS)), F.asc_nulls_last(c(key)))
             .limit(k))


def top_buyers(orders: DataFrame, income: DataFrame, k: int = 10, more: Parts = ()) -> DataFrame:
    """Q6: the ``k`` buyers with most joined completed rows."""
    return top_by_joined_rows(orders, income, N.BUYER, k, more)


def top_provinces(orders: DataFrame, income: DataFrame, k: int = 10, more: Parts = ()) -> DataFrame:
    """Q7: the ``k`` provinces with most joined completed rows."""
    return top_by_joined_rows(orders, income, N.PROVINCE, k, more)


ADJUSTMENT_COLUMNS = [N.ORDER_ID, N.TYPE, N.ORDER_STATUS, N.SKU_CATEGORY, N.QUANTITY,
                      N.TOTAL_REVENUE, N.SETTLEMENT, N.CREATED_TIME]


def adjustments(orders: DataFrame, income: DataFrame, more: Parts = ()) -> DataFrame:
    """Q8: joined rows of compensated orders whose entry type is not 'Order'
    (a null type is dropped here, by SQL comparison), newest first.

    An entry with another type makes its own order a compensation, so the
    type test implies the label and the classification is not needed.
    """
    other = c(N.TYPE) != F.lit(N.TYPE_ORDER)
    joined = [order_income(o, i.where(other)) for o, i in [(orders, income), *more]]
    return (reduce(DataFrame.unionByName, joined)
             .orderBy(F.desc_nulls_last(c(N.CREATED_TS)), F.asc_nulls_last(c(N.ORDER_ID)))
             .select(*[c(x) for x in ADJUSTMENT_COLUMNS]))


def _joined_group_report(orders: DataFrame, income: DataFrame, keys: Sequence[str],
                         returned_as_rate: bool, also: str | None = None, more: Parts = ()) -> DataFrame:
    ret = _is(N.RETURN_TYPE, N.RETURN_REFUND)
    j = joined_lines([(orders, income), *more], keys, {"n_ret": ret})
    joined_rows = F.col("n_lines") * F.col("n_inc")
    returned_rows = F.col("n_ret") * F.col("n_inc")
    returned = (F.sum(returned_rows) / F.sum(joined_rows) if returned_as_rate
                else F.sum(returned_rows))
    out = (j.groupBy(*[c(k).alias(k) for k in keys])
             .agg(F.count(F.lit(1)).alias(N.N_ORDERS),
                  exact_sum_of_lanes("rev_", F.col("n_lines")).alias(N.REVENUE),
                  returned.alias(N.RETURN_RATE if returned_as_rate else N.N_RETURNED)))
    if also is not None:
        out = out.withColumn(also, sku_category(c(N.SELLER_SKU)))
    return out.orderBy(F.desc_nulls_last(c(N.REVENUE)), *[F.asc_nulls_last(c(k)) for k in keys])


def region_analysis(orders: DataFrame, income: DataFrame, more: Parts = ()) -> DataFrame:
    """Q9: per province: distinct orders with entries, revenue over the join,
    share of joined rows that are returns."""
    return _joined_group_report(orders, income, [N.PROVINCE], returned_as_rate=True, more=more)


def product_analysis(orders: DataFrame, income: DataFrame, more: Parts = ()) -> DataFrame:
    """Q10: per (product, seller SKU, category): distinct orders, revenue
    over the join, joined rows that are returns.

    The category is a function of the seller SKU (cleaning derives it), so it
    is computed for the result rows and stays out of the shuffled keys.
    """
    out = _joined_group_report(orders, income, [N.PRODUCT_NAME, N.SELLER_SKU], returned_as_rate=False,
                               also=N.SKU_CATEGORY, more=more)
    return out.select(*[c(x) for x in (N.PRODUCT_NAME, N.SELLER_SKU, N.SKU_CATEGORY, N.N_ORDERS,
                                       N.REVENUE, N.N_RETURNED)])


def with_money_text(df: DataFrame, columns: Sequence[str] = (N.REVENUE,)) -> DataFrame:
    """Replace money columns by their display text (``1,234 ₫``), keeping order."""
    return df.withColumns({col: money_text(c(col)) for col in columns})


def error_by_month(orders: DataFrame) -> DataFrame:
    """Q11: order lines with substatus 'Error Order' per month."""
    return (orders.where(c(N.ORDER_SUBSTATUS) == F.lit(N.SUBSTATUS_ERROR))
                  .groupBy(c(N.ORDER_MONTH).alias(N.MONTH_VN))
                  .agg(F.count(F.lit(1)).alias(N.N_ERRORS))
                  .orderBy(F.asc_nulls_last(c(N.MONTH_VN))))


def error_list(orders: DataFrame) -> DataFrame:
    """Q12: every column of the order lines with substatus 'Error Order'."""
    return orders.where(c(N.ORDER_SUBSTATUS) == F.lit(N.SUBSTATUS_ERROR))
