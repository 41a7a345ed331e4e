"""The frames behind the dashboard's figures (V-1 … V-5); no rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerlens import names as N
from sellerlens.operators import reports as R

c = N.c

ORDER_SERIES = [N.N_ORDERS, N.N_COMPLETED, N.N_CANCELED]
INCOME_SERIES = [N.REVENUE, N.NET_REVENUE]


def to_long(df: DataFrame, key: str, series: Sequence[str]) -> DataFrame:
    """V-1: wide to long with ``variable``/``value`` columns; V-2: the key
    axis in ascending order, nulls last."""
    return (df.unpivot([c(key)], [c(s) for s in series], "variable", "value")
              .orderBy(F.asc_nulls_last(c(key)), F.asc("variable")))


def chart_orders_long(orders: DataFrame) -> DataFrame:
    """Grouped bars of Q1: three series per month."""
    return to_long(R.orders_by_month(orders), N.ORDER_MONTH, ORDER_SERIES)


def chart_income_long(income: DataFrame) -> DataFrame:
    """Grouped bars of Q4: revenue and settlement per month."""
    return to_long(R.income_by_month(income), N.MONTH, INCOME_SERIES)


def sku_share(orders: DataFrame) -> DataFrame:
    """V-3: each category's share of all units (the pie).

    The total is a scalar subquery (one global aggregate, a separate small
    job whose single value is inlined), so neither a one-partition window
    nor a join is needed.
    """
    summary = R.sku_summary(orders)
    total = summary.agg(F.sum(c(N.SUM_QTY))).scalar()
    return summary.select(c(N.SKU_CATEGORY), c(N.SUM_QTY), (c(N.SUM_QTY) / total).alias("share"))


WIDEST = 200


def to_wide(df: DataFrame, key: str, series: str, value: str, widest: int = WIDEST) -> DataFrame:
    """V-4: long to wide, one row a ``key`` and one column a ``series`` value.

    ``df`` has one row a (key, series) pair. A first pass finds the series
    (in ascending order, null last as ``null``; at most ``widest`` + 1 values
    leave the tasks), a second one fills the columns. A cell without a row is
    null, one with the value zero is zero. More than ``widest`` series are
    too many for columns: then the result is ``df``'s long form, the columns
    key, series, value. A series named like the key, or like an earlier one
    but for upper and lower case, gets a ``_1``.
    """
    found = df.select(c(series).alias("s")).distinct().orderBy(F.asc_nulls_last("s")).limit(widest + 1).collect()
    if len(found) > widest:
        return df.select(c(key), c(series), c(value)).orderBy(F.asc_nulls_last(c(key)), F.asc_nulls_last(c(series)))
    taken, columns = {key.lower()}, []
    for r in found:
        name = str(r["s"]) if r["s"] is not None else "null"
        k, own = 0, name
        while own.lower() in taken:
            k += 1
            own = f"{name}_{k}"
        taken.add(own.lower())
        columns.append(F.max(F.when(c(series).eqNullSafe(F.lit(r["s"])), c(value))).alias(own))
    keys = df.groupBy(c(key).alias(key))
    wide = keys.agg(*columns) if columns else keys.agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    return wide.orderBy(F.asc_nulls_last(c(key)))


def sku_monthly_pivot(orders: DataFrame, widest: int = WIDEST) -> DataFrame:
    """Q3's units as one row a month and one column a SKU category."""
    return to_wide(R.sku_monthly(orders), N.MONTH_VN, N.PRODUCT_KIND, N.TOTAL_QUANTITY, widest)


def chart_traffic(overview: DataFrame) -> DataFrame:
    """V-5: page views (bars) and store visits (line) per month."""
    return R.traffic_by_month(overview).select(c(N.MONTH_VN), c(N.PAGE_VIEWS), c(N.STORE_VISITS))
