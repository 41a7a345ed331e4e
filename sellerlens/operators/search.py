"""Parameterised searches (P1 … P5).

User input is always a Column literal, never pasted into SQL text, so a
value like ``x' OR '1'='1`` is just a value that matches nothing. The
equality filters are pushed into both Parquet scans (the join condition
lets Spark infer the filter on the other side).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerlens import names as N
from sellerlens.operators.income import classify_income
from sellerlens.plans.joins import order_income

c = N.c

# Parameters of the registered example searches (values present in the
# sf0.01 fixture).
DEFAULT_SEARCH = {
    "order_id": "500000000000000143",
    "city": "đà nẵng",
    "sku_id": "558",
    "buyer": "Customer#000001378",
}

CITY_COLUMNS = [N.ORDER_ID, N.ORDER_STATUS, N.SKU_CATEGORY, N.QUANTITY, N.TOTAL_REVENUE,
                N.SETTLEMENT, N.CREATED_TIME, N.PROVINCE, N.BUYER]
SKU_COLUMNS = [N.ORDER_ID, N.ORDER_STATUS, N.SKU_CATEGORY, N.QUANTITY, N.TOTAL_REVENUE,
               N.SETTLEMENT, N.PROVINCE, N.BUYER]
BUYER_COLUMNS = [N.ORDER_ID, N.ORDER_STATUS, N.SKU_CATEGORY, N.QUANTITY, N.TOTAL_REVENUE,
                 N.SETTLEMENT, N.CREATED_TIME, N.PROVINCE]


def find_by_order(orders: DataFrame, income: DataFrame, order_id: str,
                  entries: DataFrame | None = None) -> DataFrame:
    """P1: every column of the joined rows of one order.

    The ID is applied to both sides before the join (same result), so it
    reaches both scans. Given the unclassified ``entries`` (``Tables.entries``),
    only that order's entries are classified: every label depends only on
    entries with the same related ID, so the result is identical, and the
    ID filter reaches the classification's scans and aggregations too
    instead of them grouping every ID of the table.
    """
    o = orders.where(c(N.ORDER_ID) == F.lit(order_id))
    if entries is not None:
        mine = entries.where(c(N.RELATED_ORDER_ID).cast("string") == F.lit(order_id))
        i = classify_income(mine)
    else:
        i = income.where(c(N.RELATED_ORDER_ID) == F.lit(order_id))
    return order_income(o, i)


def city_condition(text: str, literal: bool = False):
    """``Province ILIKE '%text%'``; ``%`` and ``_`` in ``text`` are wildcards
    unless ``literal``. A backslash is an ordinary character, as in DuckDB."""
    if literal:
        return F.lower(c(N.PROVINCE)).contains(F.lower(F.lit(text)))
    return c(N.PROVINCE).ilike("%" + text.replace("\\", "\\\\") + "%")


def find_by_city(orders: DataFrame, income: DataFrame, city: str, literal: bool = False) -> DataFrame:
    """P2: completed joined rows whose province contains ``city`` (case-blind).

    No label is shown here nor in P3 and P4, so the classification of
    ``income`` drops out of the plan: two scans, one join."""
    cond = (c(N.ORDER_STATUS) == F.lit(N.STATUS_COMPLETED)) & city_condition(city, literal)
    o = orders.where(cond)
    return order_income(o, income).select(*[c(x) for x in CITY_COLUMNS])


def find_by_sku(orders: DataFrame, income: DataFrame, sku_id: str) -> DataFrame:
    """P3: joined rows of one SKU ID, any status."""
    o = orders.where(c(N.SKU_ID) == F.lit(sku_id))
    return order_income(o, income).select(*[c(x) for x in SKU_COLUMNS])


def find_by_buyer(orders: DataFrame, income: DataFrame, buyer: str) -> DataFrame:
    """P4: joined rows of one buyer, eight columns."""
    o = orders.where(c(N.BUYER) == F.lit(buyer))
    return order_income(o, income).select(*[c(x) for x in BUYER_COLUMNS])


def has_matches(result: DataFrame) -> bool:
    """P5: the empty test; stops at the first row found."""
    return not result.isEmpty()


def match_counts(orders: DataFrame, income: DataFrame, order_id: str, city: str,
                 sku_id: str, buyer: str) -> DataFrame:
    """P5: the number of rows each search returns, one row per search."""
    searches = {
        "order": find_by_order(orders, income, order_id),
        "city": find_by_city(orders, income, city),
        "sku": find_by_sku(orders, income, sku_id),
        "buyer": find_by_buyer(orders, income, buyer),
    }
    parts = [df.agg(F.count(F.lit(1)).alias("matches")).select(F.lit(name).alias("search"), "matches")
             for name, df in searches.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
