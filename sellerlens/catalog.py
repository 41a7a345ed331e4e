"""Every registered query: ``name -> f(spark, sf_dir) -> DataFrame``.

Each query reads the driver tables below ``sf_dir`` through the derived
fixture (written once per application as Parquet in the shared folder),
cleans and classifies the whole tables, and runs one operator. Nothing is
collected; the caller decides what to do with the DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sellerlens import names as N
from sellerlens.functions import mapping as M
from sellerlens.functions import text as T
from sellerlens.operators import adhoc, apportion, chartdata, cleaning, distinct, income, incomestate, reports, search, searchindex
from sellerlens.session import scratch_path
from sellerlens.sinks.colocated import Colocated, write_colocated
from sellerlens.sinks.csv import read_csv, write_csv
from sellerlens.sinks.json import write_json_array
from sellerlens.sinks.tables import write_tables
from sellerlens.sources import fixtures
from sellerlens.sources.files import (INCOME_TYPES, ORDERS_TYPES, OVERVIEW_TYPES, Tables,
                                      conform, load_tables, read_json_table, read_table, row_counts)
from sellerlens.sources.jsonarray import read_json_array

Query = Callable[[SparkSession, str], DataFrame]
c = N.c

JSON_SPLIT = 4 << 20       # bytes of a task of ``scan_json_array``


# Lazy DataFrames are immutable and hold no data, so one set per session and
# input folder is reused: later queries skip file listing and re-analysis.
_memo: dict[tuple, tuple] = {}


def _memoised(kind: str, spark: SparkSession, sf_dir: str, build):
    key = (kind, id(spark), sf_dir.rstrip("/"))
    hit = _memo.get(key)
    if hit is None or hit[0] is not spark:
        hit = (spark, build())
        while len(_memo) >= 16:
            _memo.pop(next(iter(_memo)))
        _memo[key] = hit
    return hit[1]


def raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three uncleaned input tables (conformed types)."""
    def build():
        p = fixtures.materialize(spark, sf_dir)
        return (conform(read_table(spark, p.orders), ORDERS_TYPES),
                conform(read_table(spark, p.income), INCOME_TYPES),
                conform(read_table(spark, p.overview), OVERVIEW_TYPES, strip=False))
    return _memoised("raw", spark, sf_dir, build)


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Cleaned orders, classified income, overview."""
    def build():
        p = fixtures.materialize(spark, sf_dir)
        return load_tables(spark, p.orders, p.income, p.overview)
    return _memoised("tables", spark, sf_dir, build)


def search_index(spark: SparkSession, sf_dir: str) -> searchindex.SearchIndex:
    """The prepared tables, written and indexed once per session and folder."""
    def build():
        base = scratch_path(spark, "store")
        return searchindex.build_index(spark, write_tables(tables(spark, sf_dir), base), f"{base}/index")
    return _memoised("index", spark, sf_dir, build)


def colocated(spark: SparkSession, sf_dir: str) -> Colocated:
    """Lines and entries stored by order ID, once per session and folder."""
    def build():
        base = scratch_path(spark, "colocated")
        return write_colocated(spark, tables(spark, sf_dir), base, "colocated_" + base.rsplit("/", 1)[1])
    return _memoised("colocated", spark, sf_dir, build)


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored roll-up of distinct orders, written once per session and folder."""
    return _memoised("rollup", spark, sf_dir, lambda: distinct.write_rollup(
        spark, tables(spark, sf_dir).orders, scratch_path(spark, "rollup")))


def _pairs(df: DataFrame, raw_col, out_col) -> DataFrame:
    """Distinct (input value, output value) pairs of a cleaning step."""
    return df.select(raw_col.alias("raw"), out_col.alias("cleaned")).distinct()


def _orders_raw(spark, sf_dir):
    return raw(spark, sf_dir)[0]


def _income_raw(spark, sf_dir):
    return raw(spark, sf_dir)[1]


def _ids(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(c(N.ADJUSTMENT_ID), c(N.RELATED_ORDER_ID), *[c(x) for x in cols])


# ---------------------------------------------------------------- sources

def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2: the overview written as JSON by the executors and read back."""
    ov = raw(spark, sf_dir)[2]
    path = scratch_path(spark, "json")
    ov.write.json(path)
    return read_json_table(spark, path, ov.schema, multi_line=False)


def scan_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2, array form: the settlement entries written as array documents
    and read back, several tasks a document."""
    inc = raw(spark, sf_dir)[1]
    path = write_json_array(inc, scratch_path(spark, "json-array"))
    return read_json_array(spark, path, inc.schema, split_bytes=JSON_SPLIT)


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1: the cleaned order lines written as CSV by the executors and
    read back (texts with spaces at the ends, quotes and line breaks)."""
    o = tables(spark, sf_dir).orders
    path = write_csv(o, scratch_path(spark, "csv"))
    return read_csv(spark, path, o.schema, multi_line=True)


BATCHES = 3


def classify_income_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IN-2 … IN-10 kept up to date: all entries, added in several batches."""
    inc, base = raw(spark, sf_dir)[1], scratch_path(spark, "income-state")
    turn = F.pmod(F.xxhash64(c(N.ADJUSTMENT_ID)), F.lit(BATCHES))
    for i in range(BATCHES):
        incomestate.add_batch(spark, base, inc.where(turn == i), f"batch-{i}", buckets=16)
    return incomestate.read_entries(spark, base)


ADHOC_EXAMPLE = (
    'SELECT strftime("Created_Timestamp", \'%Y-%m\') AS "Tháng", "SKU Category" AS "Loại sản phẩm", '
    'SUM("Quantity") AS "Total_Quantity", '
    'SUM(CASE WHEN "Order Status" = :status THEN 1 ELSE 0 END) AS "Completed_Orders" '
    'FROM orders WHERE "SKU Category" IS NOT NULL GROUP BY 1, 2 ORDER BY 1, 3 DESC')


def adhoc_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AH-1: user SQL (double-quoted names, strftime, a bound parameter)."""
    session = adhoc.sql_session(spark, lambda s: tables(s, sf_dir))
    return adhoc.run_sql(session, ADHOC_EXAMPLE, {"status": N.STATUS_COMPLETED})


# The dashboard's own statements, with a positional sort and plain names.
ADHOC_REPORTS = {
    "adhoc_orders_by_month": (
        'SELECT strftime("Created_Timestamp", \'%Y-%m\') AS "Order_Month", COUNT(DISTINCT "Order ID") AS n_orders, '
        'COUNT(DISTINCT CASE WHEN "Order Status" = \'Canceled\' THEN "Order ID" END) AS n_canceled, '
        'COUNT(DISTINCT CASE WHEN "Order Status" = \'Completed\' THEN "Order ID" END) AS n_completed '
        'FROM orders GROUP BY 1 ORDER BY 1'),
    "adhoc_income_by_month": (
        'SELECT strftime("Order settled time", \'%Y-%m\') AS "Month", '
        'round(SUM(CAST("Total revenue" AS DOUBLE)), 4) AS revenue, '
        'round(SUM(CAST("Total settlement amount" AS DOUBLE)), 4) AS net FROM income GROUP BY 1 ORDER BY 1'),
    "adhoc_traffic": (
        'SELECT strftime(\'%Y-%m\', CAST("Ngày" AS DATE)) AS "Month", SUM("Lượt xem trang") AS views, '
        'round(AVG("Tỷ lệ chuyển đổi"), 9) AS conversion FROM overview GROUP BY 1 ORDER BY 1'),
    "adhoc_errors": (
        'SELECT strftime(\'Tháng %m/%Y (%b)\', CAST("Created_Timestamp" AS DATE)) AS "Month", COUNT(*) AS errors '
        'FROM orders WHERE "Order Substatus" = \'Error Order\' GROUP BY 1 ORDER BY 1'),
}


def _adhoc_report(name: str) -> Query:
    return lambda spark, sf_dir: adhoc.run_sql(
        adhoc.sql_session(spark, lambda s: tables(s, sf_dir)), ADHOC_REPORTS[name])


# A rule set with group references and a cascade (the fold, not the lookup).
GENERAL_RULES = [
    (r"^SC_X(\d)$", r"SC-\1x\g<1>"),
    (r"^SC-(\d)x(\d)$", r"\g<2>-of-\1 $"),
    (r"(?i)^bthp([_-])(.*)$", r"B\1\g<2>"),
]


# ---------------------------------------------------------------- registry

S = search.DEFAULT_SEARCH

QUERIES: dict[str, Query] = {
    # sources and sinks
    "scan_orders": lambda s, d: read_table(s, fixtures.materialize(s, d).orders),
    "scan_income": lambda s, d: read_table(s, fixtures.materialize(s, d).income),
    "scan_overview": lambda s, d: read_table(s, fixtures.materialize(s, d).overview),
    "scan_json": scan_json,
    "scan_json_array": scan_json_array,
    "load_counts": lambda s, d: row_counts(tables(s, d)),
    "csv_roundtrip": csv_roundtrip,
    # order cleaning, step by step and whole
    "clean_headers": lambda s, d: cleaning.clean_headers(
        (lambda r: r.toDF(*[f" {x}\t" for x in r.columns]))(_income_raw(s, d))),
    "clean_text": lambda s, d: _pairs(_orders_raw(s, d), c(N.CREATED_TIME), T.clean_text(c(N.CREATED_TIME))),
    "clean_order_text": lambda s, d: cleaning.clean_order_text(_orders_raw(s, d)),
    "province_prefix": lambda s, d: _pairs(_orders_raw(s, d), c(N.PROVINCE), T.province_prefix(c(N.PROVINCE))),
    "province_map": lambda s, d: _pairs(_orders_raw(s, d), c(N.PROVINCE), T.province_norm(c(N.PROVINCE))),
    "country_norm": lambda s, d: _pairs(_orders_raw(s, d), c(N.COUNTRY), T.country_norm(c(N.COUNTRY))),
    "sku_category": lambda s, d: _pairs(_orders_raw(s, d), c(N.SELLER_SKU), T.sku_category(c(N.SELLER_SKU))),
    "rewrite_rules": lambda s, d: _pairs(_orders_raw(s, d), c(N.SELLER_SKU),
                                         M.rewrite_rules(c(N.SELLER_SKU), M.SKU_RULES, compile_lookup=False)),
    "created_ts": lambda s, d: _pairs(_orders_raw(s, d), T.clean_text(c(N.CREATED_TIME)),
                                      T.created_ts(T.clean_text(c(N.CREATED_TIME)))),
    "order_month": lambda s, d: _pairs(tables(s, d).orders, c(N.CREATED_TS), c(N.ORDER_MONTH)),
    "clean_orders": lambda s, d: tables(s, d).orders,
    # income classification, step by step and whole
    "abs_fees": lambda s, d: _ids(income.abs_fees(_income_raw(s, d)), N.TOTAL_FEES, N.ABS_FEES),
    "flag_duplicates": lambda s, d: _ids(income.flag_duplicates(_income_raw(s, d)), N.CLASSIFY),
    "flag_paydouble": lambda s, d: _ids(income.flag_paydouble(_income_raw(s, d)), N.PAYDOUBLE),
    "prefix_flag": lambda s, d: _ids(income.prefix_flag(_income_raw(s, d)), "starts_with_7"),
    "group_size": lambda s, d: _ids(income.group_size(_income_raw(s, d)), "n_rid"),
    "group_any": lambda s, d: _ids(income.group_any(_income_raw(s, d)), "comp"),
    "order_type": lambda s, d: _ids(income.order_type(_income_raw(s, d)), N.ORDER_TYPE),
    "settled_date": lambda s, d: _pairs(_income_raw(s, d), c(N.SETTLED_TIME), T.settled_date(c(N.SETTLED_TIME))),
    "classify_income": lambda s, d: tables(s, d).income,
    "classify_income_batches": classify_income_batches,
    "rewrite_rules_general": lambda s, d: _pairs(_orders_raw(s, d), c(N.SELLER_SKU),
                                                 M.rewrite_rules(c(N.SELLER_SKU), GENERAL_RULES)),
    "money_text": lambda s, d: _pairs(_income_raw(s, d), c(N.SETTLEMENT), T.money_text(c(N.SETTLEMENT))),
    # searches through the value index
    "indexed_find_order": lambda s, d: searchindex.find_by_order(s, search_index(s, d), S["order_id"]),
    "indexed_find_city": lambda s, d: searchindex.find_by_city(s, search_index(s, d), S["city"]),
    "indexed_find_sku": lambda s, d: searchindex.find_by_sku(s, search_index(s, d), S["sku_id"]),
    "indexed_find_buyer": lambda s, d: searchindex.find_by_buyer(s, search_index(s, d), S["buyer"]),
    # distinct orders of several grains from one roll-up
    "distinct_orders_total": lambda s, d: distinct.distinct_orders(rollup(s, d)),
    "distinct_orders_by_month": lambda s, d: distinct.distinct_orders(rollup(s, d), (N.ORDER_MONTH,)),
    "distinct_orders_by_category": lambda s, d: distinct.distinct_orders(rollup(s, d), (N.SKU_CATEGORY,)),
    "distinct_orders_by_month_province": lambda s, d: distinct.distinct_orders(rollup(s, d), (N.ORDER_MONTH, N.PROVINCE)),
    # reports and searches: see ON_TABLES
    # ad hoc SQL
    "adhoc_sql": adhoc_sql,
    **{name: _adhoc_report(name) for name in ADHOC_REPORTS},
}


# Reports and searches as functions of the prepared tables, so they can run
# on tables cleaned now or on tables written earlier (``sinks.tables``).
ON_TABLES: dict[str, Callable[[Tables], DataFrame]] = {
    "orders_by_month": lambda t: reports.orders_by_month(t.orders),
    "sku_summary": lambda t: reports.sku_summary(t.orders),
    "sku_monthly": lambda t: reports.sku_monthly(t.orders),
    "income_by_month": lambda t: reports.income_by_month(t.income),
    "income_by_month_text": lambda t: reports.income_by_month_text(t.income),
    "traffic_by_month": lambda t: reports.traffic_by_month(t.overview),
    "top_buyers": lambda t: reports.top_buyers(t.orders, t.income),
    "top_provinces": lambda t: reports.top_provinces(t.orders, t.income),
    "adjustments": lambda t: reports.adjustments(t.orders, t.income),
    "region_analysis": lambda t: reports.region_analysis(t.orders, t.income),
    "region_analysis_text": lambda t: reports.with_money_text(reports.region_analysis(t.orders, t.income)),
    "product_analysis": lambda t: reports.product_analysis(t.orders, t.income),
    "product_analysis_text": lambda t: reports.with_money_text(reports.product_analysis(t.orders, t.income)),
    "error_by_month": lambda t: reports.error_by_month(t.orders),
    "error_list": lambda t: reports.error_list(t.orders),
    "settlement_by_line": lambda t: apportion.share_out(t.orders, t.income).select(
        c(N.ORDER_ID), c(N.SKU_ID), c(N.QUANTITY), (c(apportion.SHARE) / float(apportion.UNITS)).alias(apportion.SHARE)),
    "settlement_by_category": lambda t: apportion.settled_by(t.orders, t.income, N.SKU_CATEGORY),
    "settlement_by_province": lambda t: apportion.settled_by(t.orders, t.income, N.PROVINCE),
    "find_order": lambda t: search.find_by_order(t.orders, t.income, S["order_id"], t.entries),
    "find_city": lambda t: search.find_by_city(t.orders, t.income, S["city"]),
    "find_sku": lambda t: search.find_by_sku(t.orders, t.income, S["sku_id"]),
    "find_buyer": lambda t: search.find_by_buyer(t.orders, t.income, S["buyer"]),
    "match_counts": lambda t: search.match_counts(t.orders, t.income, **S),
    "chart_orders_long": lambda t: chartdata.chart_orders_long(t.orders),
    "chart_income_long": lambda t: chartdata.chart_income_long(t.income),
    "sku_monthly_pivot": lambda t: chartdata.sku_monthly_pivot(t.orders),
    "sku_share": lambda t: chartdata.sku_share(t.orders),
    "chart_traffic": lambda t: chartdata.chart_traffic(t.overview),
}


def _on_tables(name: str) -> Query:
    return lambda spark, sf_dir: ON_TABLES[name](tables(spark, sf_dir))


QUERIES.update({name: _on_tables(name) for name in ON_TABLES})


def _on_colocated(report) -> Query:
    def run(spark, sf_dir):
        store = colocated(spark, sf_dir)
        return report(store.orders, store.income, more=store.parts[1:])
    return run


# The join reports without a shuffle for the join.
COLOCATED = ("top_buyers", "top_provinces", "adjustments", "region_analysis", "product_analysis")
QUERIES.update({f"colocated_{name}": _on_colocated(getattr(reports, name)) for name in COLOCATED})

FLAGSHIP = "orders_by_month"
