"""DuckDB SQL equivalents of every registered query (the correctness oracle).

Each statement derives the fixture tables from the driver's tables, repeats
the cleaning and classification in DuckDB SQL (window functions, regex
folds, a VALUES dictionary join: deliberately a different formulation from
the Spark code) and then runs the report. Conventions shared with the Spark
side: sums of BIGINT are cast back to BIGINT (DuckDB widens them to
HUGEINT), sums of DOUBLE are exact (added as HUGEINT units of 2^-72, no matter
in which order), sorts put nulls last and end
with the group key.
"""

from __future__ import annotations

from sellerlens import names as N
from sellerlens.functions import mapping as M
from sellerlens.functions.text import PY_SPACE
from sellerlens.sources import fixtures as FX
from sellerlens.operators import apportion as AP
from sellerlens.operators.search import DEFAULT_SEARCH


def q(name: str) -> str:
    """Quoted SQL identifier."""
    return '"' + name.replace('"', '""') + '"'


def lit(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def d_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{PY_SPACE}+|{PY_SPACE}+$', '', 'g')"


def d_clean(x: str) -> str:
    return d_strip(f"regexp_replace(CAST({x} AS VARCHAR), '[\\t\\r\\n]', '', 'g')")


def d_province_prefix(x: str) -> str:
    p1 = "|".join(M.PROVINCE_PREFIX_PASS_1)
    p2 = "|".join(M.PROVINCE_PREFIX_PASS_2)
    return d_strip(f"regexp_replace(regexp_replace({x}, '^({p1})', ''), '^({p2})', '')")


def d_country(x: str) -> str:
    aliases = ", ".join(lit(a) for a in M.COUNTRY_ALIASES)
    return f"CASE WHEN {x} IN ({aliases}) THEN {lit(M.COUNTRY_TARGET)} ELSE {x} END"


def d_sku(x: str) -> str:
    out = x
    for pattern, repl in M.SKU_RULES:
        out = f"regexp_replace({out}, {lit(pattern)}, {lit(repl)})"
    return out


CREATED_FMT = "'%d/%m/%Y %H:%M:%S'"
SETTLED_FMT = "'%Y/%m/%d'"


def d_created(x: str) -> str:
    """Parsed time; outside the years a pandas timestamp can hold, null."""
    t = f"try_strptime({x}, {CREATED_FMT})"
    return f"CASE WHEN {t} BETWEEN TIMESTAMP '1677-09-21 00:12:44' AND TIMESTAMP '2262-04-11 23:47:16' THEN {t} END"


_PROVINCE_VALUES = ",\n  ".join(f"({lit(k)}, {lit(v)})" for k, v in M.PROVINCE_MAP.items())
_ORDER_RAW = [q(x) for x in N.ORDER_COLUMNS]
_ORDERS_OUT = ",\n  ".join(
    [f"{d_clean(q(x))} AS {q(x)}" if x in N.ORDER_TEXT_COLUMNS else
     ("coalesce(pm.v, o1._p) AS " + q(x) if x == N.PROVINCE else
      (d_country(q(x)) + " AS " + q(x) if x == N.COUNTRY else "o1." + q(x)))
     for x in N.ORDER_COLUMNS]
    + [f"{d_sku(q(N.SELLER_SKU))} AS {q(N.SKU_CATEGORY)}",
       f"{d_created(d_clean(q(N.CREATED_TIME)))} AS {q(N.CREATED_TS)}",
       f"strftime({d_created(d_clean(q(N.CREATED_TIME)))}, '%Y-%m') AS {q(N.ORDER_MONTH)}"])

RID, ADJ, TYP = q(N.RELATED_ORDER_ID), q(N.ADJUSTMENT_ID), q(N.TYPE)
_COMP_ROW = (f"(coalesce(starts_with(CAST({ADJ} AS VARCHAR), '7'), false) "
             f"OR {TYP} IS DISTINCT FROM 'Order')")

def prefix(orders_sql: str = FX.DUCK_ORDERS, income_sql: str = FX.DUCK_INCOME,
           overview_sql: str = FX.DUCK_OVERVIEW) -> str:
    """The shared CTEs; the three sources default to the fixture derivation."""
    return f"""WITH
mkt_orders AS ({orders_sql}),
mkt_income AS ({income_sql}),
mkt_overview AS ({overview_sql}),
province_map AS (SELECT * FROM (VALUES
  {_PROVINCE_VALUES}) AS t(k, v)),
o1 AS (SELECT *, {d_province_prefix(q(N.PROVINCE))} AS _p FROM mkt_orders),
c_orders AS (SELECT
  {_ORDERS_OUT}
  FROM o1 LEFT JOIN province_map pm ON pm.k = o1._p),
i1 AS (SELECT CAST({ADJ} AS VARCHAR) AS {ADJ}, CAST({RID} AS VARCHAR) AS {RID}, {TYP},
  {q(N.TOTAL_REVENUE)}, {q(N.TOTAL_FEES)}, {q(N.SETTLEMENT)}, {q(N.SETTLED_TIME)} FROM mkt_income),
c_income AS (SELECT {ADJ}, {RID}, {TYP}, {q(N.TOTAL_REVENUE)}, {q(N.TOTAL_FEES)}, {q(N.SETTLEMENT)},
  CAST(try_strptime({q(N.SETTLED_TIME)}, {SETTLED_FMT}) AS DATE) AS {q(N.SETTLED_TIME)},
  abs({q(N.TOTAL_FEES)}) AS {q(N.ABS_FEES)},
  CASE WHEN count(*) OVER (PARTITION BY {RID}) > 1 THEN 'Duplicate' ELSE 'Not Duplicate' END AS {q(N.CLASSIFY)},
  CASE WHEN count(*) OVER (PARTITION BY {RID}, {ADJ}) > 1 THEN 'Yes' ELSE 'No' END AS {q(N.PAYDOUBLE)},
  CASE WHEN bool_or({_COMP_ROW}) OVER (PARTITION BY {RID}) THEN 'Compensation'
       WHEN count(*) OVER (PARTITION BY {RID}) > 1 THEN 'DoublePaid' ELSE 'Normal' END AS {q(N.ORDER_TYPE)}
  FROM i1),
joined AS (SELECT * FROM c_orders o JOIN c_income i ON o.{q(N.ORDER_ID)} = i.{RID})
"""


PREFIX = prefix()


_PREFIX = [PREFIX]


def _with(body: str) -> str:
    return _PREFIX[0] + body


# A double as a whole number of 2^-72, in which sums are exact.
_UNITS = "CAST(CAST({x} AS DOUBLE) * pow(2, 72) AS HUGEINT)"


def _money(x: str) -> str:
    return f"CAST(SUM({_UNITS.format(x=x)}) AS DOUBLE) / pow(2, 72)"


def _money_text(x: str) -> str:
    return f"format('{{:,.0f}}{N.CURRENCY_SUFFIX}', {x})"


def _pairs(raw: str, out: str, table: str) -> str:
    return f"SELECT DISTINCT {raw} AS raw, {out} AS cleaned FROM {table}"


S = DEFAULT_SEARCH
ADJ_COLS = ", ".join(q(x) for x in [N.ORDER_ID, N.TYPE, N.ORDER_STATUS, N.SKU_CATEGORY, N.QUANTITY,
                                    N.TOTAL_REVENUE, N.SETTLEMENT, N.CREATED_TIME])
CITY_COLS = ", ".join(q(x) for x in [N.ORDER_ID, N.ORDER_STATUS, N.SKU_CATEGORY, N.QUANTITY,
                                     N.TOTAL_REVENUE, N.SETTLEMENT, N.CREATED_TIME, N.PROVINCE,
                                     N.BUYER])
SKU_COLS = ", ".join(q(x) for x in [N.ORDER_ID, N.ORDER_STATUS, N.SKU_CATEGORY, N.QUANTITY,
                                    N.TOTAL_REVENUE, N.SETTLEMENT, N.PROVINCE, N.BUYER])
BUYER_COLS = ", ".join(q(x) for x in [N.ORDER_ID, N.ORDER_STATUS, N.SKU_CATEGORY, N.QUANTITY,
                                      N.TOTAL_REVENUE, N.SETTLEMENT, N.CREATED_TIME, N.PROVINCE])

_Q1 = f"""SELECT strftime({q(N.CREATED_TS)}, '%Y-%m') AS {q(N.ORDER_MONTH)},
  COUNT(DISTINCT {q(N.ORDER_ID)}) AS {q(N.N_ORDERS)},
  COUNT(DISTINCT CASE WHEN {q(N.ORDER_STATUS)} = 'Canceled' THEN {q(N.ORDER_ID)} END) AS {q(N.N_CANCELED)},
  COUNT(DISTINCT CASE WHEN {q(N.ORDER_STATUS)} = 'Completed' THEN {q(N.ORDER_ID)} END) AS {q(N.N_COMPLETED)}
FROM c_orders GROUP BY 1 ORDER BY 1 NULLS LAST"""

_Q2 = f"""SELECT {q(N.SKU_CATEGORY)},
  SUM({q(N.QUANTITY)}) AS {q(N.SUM_QTY)},
  CAST(SUM(CASE WHEN {q(N.ORDER_STATUS)} = 'Completed' THEN 1 ELSE 0 END) AS BIGINT) AS {q(N.COMPLETED_LINES)}
FROM c_orders WHERE {q(N.SKU_CATEGORY)} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1"""

_Q3 = f"""SELECT strftime({q(N.CREATED_TS)}, '%Y-%m') AS {q(N.MONTH_VN)}, {q(N.SKU_CATEGORY)} AS {q(N.PRODUCT_KIND)},
  SUM({q(N.QUANTITY)}) AS {q(N.TOTAL_QUANTITY)},
  CAST(SUM(CASE WHEN {q(N.ORDER_STATUS)} = 'Completed' THEN 1 ELSE 0 END) AS BIGINT) AS {q(N.COMPLETED_ORDERS)}
FROM c_orders WHERE {q(N.SKU_CATEGORY)} IS NOT NULL GROUP BY 1, 2 ORDER BY 1 NULLS LAST, 3 DESC NULLS LAST, 2"""

_Q4 = f"""SELECT strftime({q(N.SETTLED_TIME)}, '%Y-%m') AS {q(N.MONTH)},
  {_money(q(N.TOTAL_REVENUE))} AS {q(N.REVENUE)}, {_money(q(N.SETTLEMENT))} AS {q(N.NET_REVENUE)}
FROM c_income GROUP BY 1 ORDER BY 1 NULLS LAST"""

_Q5 = f"""SELECT strftime(CAST({q(N.DAY)} AS DATE), '%Y-%m') AS {q(N.MONTH_VN)},
  CAST(SUM({q(N.PAGE_VIEWS)}) AS BIGINT) AS {q(N.PAGE_VIEWS)},
  CAST(SUM({q(N.STORE_VISITS)}) AS BIGINT) AS {q(N.STORE_VISITS)},
  {_money(q(N.CONVERSION))} / COUNT({q(N.CONVERSION)}) AS {q(N.CONVERSION)}
FROM mkt_overview GROUP BY 1 ORDER BY 1 NULLS LAST"""


def _top(key: str) -> str:
    return f"""SELECT {q(key)}, COUNT({q(N.ORDER_ID)}) AS {q(N.TOTAL_ORDERS)} FROM joined
WHERE {q(N.ORDER_STATUS)} = 'Completed' AND {q(key)} IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""


_Q8 = f"""SELECT {ADJ_COLS} FROM joined
WHERE {q(N.ORDER_TYPE)} = 'Compensation' AND {q(N.TYPE)} != 'Order'
ORDER BY {q(N.CREATED_TS)} DESC NULLS LAST, {q(N.ORDER_ID)}"""

_Q9 = f"""SELECT {q(N.PROVINCE)}, COUNT(DISTINCT {q(N.ORDER_ID)}) AS {q(N.N_ORDERS)},
  {_money(q(N.TOTAL_REVENUE))} AS {q(N.REVENUE)},
  SUM(CASE WHEN {q(N.RETURN_TYPE)} = 'Return/Refund' THEN 1 ELSE 0 END) / COUNT(*) AS {q(N.RETURN_RATE)}
FROM joined GROUP BY 1 ORDER BY 3 DESC NULLS LAST, 1 NULLS LAST"""

_Q10 = f"""SELECT {q(N.PRODUCT_NAME)}, {q(N.SELLER_SKU)}, {q(N.SKU_CATEGORY)},
  COUNT(DISTINCT {q(N.ORDER_ID)}) AS {q(N.N_ORDERS)},
  {_money(q(N.TOTAL_REVENUE))} AS {q(N.REVENUE)},
  CAST(SUM(CASE WHEN {q(N.RETURN_TYPE)} = 'Return/Refund' THEN 1 ELSE 0 END) AS BIGINT) AS {q(N.N_RETURNED)}
FROM joined GROUP BY 1, 2, 3 ORDER BY 5 DESC NULLS LAST, 1 NULLS LAST, 2 NULLS LAST, 3 NULLS LAST"""

_Q11 = f"""SELECT strftime(CAST({q(N.CREATED_TS)} AS DATE), '%Y-%m') AS {q(N.MONTH_VN)},
  COUNT(*) AS {q(N.N_ERRORS)}
FROM c_orders WHERE {q(N.ORDER_SUBSTATUS)} = 'Error Order' GROUP BY 1 ORDER BY 1 NULLS LAST"""

_Q12 = f"SELECT * FROM c_orders WHERE {q(N.ORDER_SUBSTATUS)} = 'Error Order'"


def _unpivot(source: str, key: str, cols: list[str]) -> str:
    parts = [f"SELECT {q(key)}, {lit(col)} AS variable, {q(col)} AS value FROM ({source})"
             for col in cols]
    return "\nUNION ALL\n".join(parts)


def queries(sources: tuple[str, str, str] | None = None) -> dict[str, str]:
    """SQL per key. ``sources`` optionally replaces the three derived inputs
    by other SQL (e.g. ``SELECT * FROM read_parquet(...)`` of written files)."""
    _PREFIX[0] = PREFIX if sources is None else prefix(*sources)
    try:
        return _queries()
    finally:
        _PREFIX[0] = PREFIX


def bodies() -> dict[str, str]:
    """The report part of each query, without the shared CTEs: runnable
    where ``c_orders``, ``c_income``, ``mkt_overview`` and ``joined`` exist
    as tables or views (used to time reports over prepared tables)."""
    _PREFIX[0] = ""
    try:
        return _queries()
    finally:
        _PREFIX[0] = PREFIX


_UNITS_OF = f"CAST(round({q(N.SETTLEMENT)} * 100) AS BIGINT)"
_LINE_ORDER = ", ".join(f"{q(x)} NULLS FIRST" for x in [*N.ORDER_COLUMNS, N.SKU_CATEGORY, N.CREATED_TS, N.ORDER_MONTH])

# Each order's settlement over its lines in hundredths, by largest remainder.
_SHARES = f""", sh_t AS (SELECT {RID} AS sid, CAST(coalesce(sum({_UNITS_OF}), 0) AS HUGEINT) AS total
  FROM c_income WHERE {RID} IS NOT NULL GROUP BY 1),
sh_l AS (SELECT o.*, total, row_number() OVER (ORDER BY {_LINE_ORDER}) AS line_no,
  CAST(round(1000 * greatest(coalesce({q(N.QUANTITY)}, 0), 0)) AS HUGEINT) AS w0 FROM c_orders o LEFT JOIN sh_t ON sid = {q(N.ORDER_ID)}),
sh_w AS (SELECT *, CASE WHEN sum(w0) OVER p = 0 THEN 1 ELSE w0 END AS w FROM sh_l WINDOW p AS (PARTITION BY {q(N.ORDER_ID)})),
sh_s AS (SELECT *, CAST(sum(w) OVER p AS HUGEINT) AS whole FROM sh_w WINDOW p AS (PARTITION BY {q(N.ORDER_ID)})),
sh_f AS (SELECT *, abs(total) * w // whole AS units, abs(total) * w % whole AS rest FROM sh_s),
sh_r AS (SELECT *, row_number() OVER (PARTITION BY {q(N.ORDER_ID)} ORDER BY rest DESC, line_no) AS place,
  abs(total) - sum(units) OVER (PARTITION BY {q(N.ORDER_ID)}) AS surplus FROM sh_f),
shares AS (SELECT *, CAST(CASE WHEN total < 0 THEN -1 ELSE 1 END * (units + CASE WHEN place <= surplus THEN 1 ELSE 0 END) AS BIGINT)
  AS {q(AP.SHARE)} FROM sh_r)
"""


def _settled_by(key: str) -> str:
    return _SHARES + f"""SELECT {q(key)}, CAST(sum({q(AP.SHARE)}) AS DOUBLE) / 100 AS {q(AP.SETTLED)}, true AS {q(AP.HAS_LINES)}
FROM shares WHERE {q(AP.SHARE)} IS NOT NULL GROUP BY 1
UNION ALL SELECT NULL, CAST(coalesce(sum({_UNITS_OF}), 0) AS DOUBLE) / 100, false
FROM c_income WHERE {RID} IS NULL OR {RID} NOT IN (SELECT {q(N.ORDER_ID)} FROM c_orders WHERE {q(N.ORDER_ID)} IS NOT NULL)"""


def _queries() -> dict[str, str]:
    city_pattern = "%" + S["city"] + "%"
    out = {
        # sources
        "scan_orders": _with("SELECT * FROM mkt_orders"),
        "scan_income": _with("SELECT * FROM mkt_income"),
        "scan_overview": _with("SELECT * FROM mkt_overview"),
        "scan_json": _with("SELECT * FROM mkt_overview"),
        "scan_json_array": _with("SELECT * FROM mkt_income"),
        "load_counts": _with("SELECT (SELECT COUNT(*) FROM c_orders) AS orders_rows, "
                             "(SELECT COUNT(*) FROM c_income) AS income_rows"),
        # order cleaning
        "clean_headers": _with("SELECT * FROM mkt_income"),
        "clean_text": _with(_pairs(q(N.CREATED_TIME), d_clean(q(N.CREATED_TIME)), "mkt_orders")),
        "clean_order_text": _with("SELECT " + ", ".join(
            d_clean(q(x)) + " AS " + q(x) if x in N.ORDER_TEXT_COLUMNS else q(x)
            for x in N.ORDER_COLUMNS) + " FROM mkt_orders"),
        "province_prefix": _with(_pairs(q(N.PROVINCE), d_province_prefix(q(N.PROVINCE)), "mkt_orders")),
        "province_map": _with(f"SELECT DISTINCT o1.{q(N.PROVINCE)} AS raw, coalesce(pm.v, o1._p) AS cleaned "
                              "FROM o1 LEFT JOIN province_map pm ON pm.k = o1._p"),
        "country_norm": _with(_pairs(q(N.COUNTRY), d_country(q(N.COUNTRY)), "mkt_orders")),
        "sku_category": _with(_pairs(q(N.SELLER_SKU), d_sku(q(N.SELLER_SKU)), "mkt_orders")),
        "rewrite_rules": _with(_pairs(q(N.SELLER_SKU), d_sku(q(N.SELLER_SKU)), "mkt_orders")),
        "created_ts": _with(_pairs(d_clean(q(N.CREATED_TIME)),
                                   d_created(d_clean(q(N.CREATED_TIME))),
                                   "mkt_orders")),
        "order_month": _with(f"SELECT DISTINCT {q(N.CREATED_TS)} AS raw, {q(N.ORDER_MONTH)} AS cleaned FROM c_orders"),
        "clean_orders": _with("SELECT * FROM c_orders"),
        # income classification
        "abs_fees": _with(f"SELECT {ADJ}, {RID}, {q(N.TOTAL_FEES)}, abs({q(N.TOTAL_FEES)}) AS {q(N.ABS_FEES)} FROM i1"),
        "flag_duplicates": _with(f"SELECT {ADJ}, {RID}, {q(N.CLASSIFY)} FROM c_income"),
        "flag_paydouble": _with(f"SELECT {ADJ}, {RID}, {q(N.PAYDOUBLE)} FROM c_income"),
        "prefix_flag": _with(f"SELECT {ADJ}, {RID}, coalesce(starts_with({ADJ}, '7'), false) AS starts_with_7 FROM i1"),
        "group_size": _with(f"SELECT {ADJ}, {RID}, count(*) OVER (PARTITION BY {RID}) AS n_rid FROM i1"),
        "group_any": _with(f"SELECT {ADJ}, {RID}, bool_or({_COMP_ROW}) OVER (PARTITION BY {RID}) AS comp FROM i1"),
        "order_type": _with(f"SELECT {ADJ}, {RID}, {q(N.ORDER_TYPE)} FROM c_income"),
        "settled_date": _with(_pairs(q(N.SETTLED_TIME),
                                     f"CAST(try_strptime({q(N.SETTLED_TIME)}, {SETTLED_FMT}) AS DATE)",
                                     "mkt_income")),
        "classify_income": _with("SELECT * FROM c_income"),
        "classify_income_batches": _with("SELECT * FROM c_income"),
        # reports
        "orders_by_month": _with(_Q1),
        "sku_summary": _with(_Q2),
        "sku_monthly": _with(_Q3),
        "income_by_month": _with(_Q4),
        "income_by_month_text": _with(
            f"SELECT {q(N.MONTH)}, {_money_text(q(N.REVENUE))} AS {q(N.REVENUE + N.FMT_SUFFIX)}, "
            f"{_money_text(q(N.NET_REVENUE))} AS {q(N.NET_REVENUE + N.FMT_SUFFIX)} FROM ({_Q4})"),
        "traffic_by_month": _with(_Q5),
        "top_buyers": _with(_top(N.BUYER)),
        "top_provinces": _with(_top(N.PROVINCE)),
        "adjustments": _with(_Q8),
        "region_analysis": _with(_Q9),
        "region_analysis_text": _with(
            f"SELECT {q(N.PROVINCE)}, {q(N.N_ORDERS)}, {_money_text(q(N.REVENUE))} AS {q(N.REVENUE)}, "
            f"{q(N.RETURN_RATE)} FROM ({_Q9})"),
        "product_analysis": _with(_Q10),
        "product_analysis_text": _with(
            f"SELECT {q(N.PRODUCT_NAME)}, {q(N.SELLER_SKU)}, {q(N.SKU_CATEGORY)}, {q(N.N_ORDERS)}, "
            f"{_money_text(q(N.REVENUE))} AS {q(N.REVENUE)}, {q(N.N_RETURNED)} FROM ({_Q10})"),
        "error_by_month": _with(_Q11),
        "error_list": _with(_Q12),
        "settlement_by_line": _with(_SHARES + f"SELECT {q(N.ORDER_ID)}, {q(N.SKU_ID)}, {q(N.QUANTITY)}, CAST({q(AP.SHARE)} AS DOUBLE) / 100 AS {q(AP.SHARE)} FROM shares"),
        "settlement_by_category": _with(_settled_by(N.SKU_CATEGORY)),
        "settlement_by_province": _with(_settled_by(N.PROVINCE)),
        "distinct_orders_total": _with(f"SELECT COUNT(DISTINCT {q(N.ORDER_ID)}) AS {q(N.N_ORDERS)} FROM c_orders"),
        **{f"distinct_orders_by_{name}": _with(
            f"SELECT {keys}, COUNT(DISTINCT {q(N.ORDER_ID)}) AS {q(N.N_ORDERS)} FROM c_orders GROUP BY {keys}")
           for name, keys in (("month", q(N.ORDER_MONTH)), ("category", q(N.SKU_CATEGORY)),
                              ("month_province", f"{q(N.ORDER_MONTH)}, {q(N.PROVINCE)}"))},
        # searches
        "find_order": _with(f"SELECT * FROM joined WHERE {q(N.ORDER_ID)} = {lit(S['order_id'])}"),
        "find_city": _with(f"SELECT {CITY_COLS} FROM joined WHERE {q(N.ORDER_STATUS)} = 'Completed' "
                           f"AND {q(N.PROVINCE)} ILIKE {lit(city_pattern)}"),
        "find_sku": _with(f"SELECT {SKU_COLS} FROM joined WHERE {q(N.SKU_ID)} = {lit(S['sku_id'])}"),
        "find_buyer": _with(f"SELECT {BUYER_COLS} FROM joined WHERE {q(N.BUYER)} = {lit(S['buyer'])}"),
        "match_counts": _with(f"""SELECT 'order' AS search, COUNT(*) AS matches FROM joined WHERE {q(N.ORDER_ID)} = {lit(S['order_id'])}
UNION ALL SELECT 'city', COUNT(*) FROM joined WHERE {q(N.ORDER_STATUS)} = 'Completed' AND {q(N.PROVINCE)} ILIKE {lit(city_pattern)}
UNION ALL SELECT 'sku', COUNT(*) FROM joined WHERE {q(N.SKU_ID)} = {lit(S['sku_id'])}
UNION ALL SELECT 'buyer', COUNT(*) FROM joined WHERE {q(N.BUYER)} = {lit(S['buyer'])}"""),
        # ad hoc SQL and CSV
        "adhoc_sql": _with(_Q3),
        # an empty text and a null are both an empty field
        "csv_roundtrip": _with("SELECT " + ", ".join(
            f"nullif({q(x)}, '') AS {q(x)}" if x not in (N.QUANTITY, N.CREATED_TS) else q(x)
            for x in [*N.ORDER_COLUMNS, N.SKU_CATEGORY, N.CREATED_TS, N.ORDER_MONTH]) + " FROM c_orders"),
        "adhoc_orders_by_month": _with(
            f"SELECT {q(N.ORDER_MONTH)}, {q(N.N_ORDERS)} AS n_orders, {q(N.N_CANCELED)} AS n_canceled, "
            f"{q(N.N_COMPLETED)} AS n_completed FROM ({_Q1})"),
        "adhoc_income_by_month": _with(
            f"SELECT {q(N.MONTH)} AS Month, round({q(N.REVENUE)}, 4) AS revenue, round({q(N.NET_REVENUE)}, 4) AS net FROM ({_Q4})"),
        "adhoc_traffic": _with(
            f"SELECT {q(N.MONTH_VN)} AS Month, {q(N.PAGE_VIEWS)} AS views, round({q(N.CONVERSION)}, 9) AS conversion FROM ({_Q5})"),
        "adhoc_errors": _with(
            f"SELECT strftime({q(N.CREATED_TS)}, 'Tháng %m/%Y (%b)') AS Month, COUNT(*) AS errors "
            f"FROM c_orders WHERE {q(N.ORDER_SUBSTATUS)} = 'Error Order' GROUP BY 1"),
        "rewrite_rules_general": _with(_pairs(
            q(N.SELLER_SKU),
            f"regexp_replace(regexp_replace(regexp_replace({q(N.SELLER_SKU)}, '^SC_X(\\d)$', 'SC-\\1x\\1'), "
            "'^SC-(\\d)x(\\d)$', '\\2-of-\\1 $'), '(?i)^bthp([_-])(.*)$', 'B\\1\\2')", "mkt_orders")),
        "money_text": _with(_pairs(q(N.SETTLEMENT), _money_text(q(N.SETTLEMENT)), "mkt_income")),
        # chart frames
        "chart_orders_long": _with(_unpivot(_Q1, N.ORDER_MONTH, [N.N_ORDERS, N.N_COMPLETED, N.N_CANCELED])),
        "chart_income_long": _with(_unpivot(_Q4, N.MONTH, [N.REVENUE, N.NET_REVENUE])),
        "sku_monthly_pivot": _with(
            f"SELECT * FROM (PIVOT ({_Q3}) ON {q(N.PRODUCT_KIND)} USING max({q(N.TOTAL_QUANTITY)}) GROUP BY {q(N.MONTH_VN)})"),
        "sku_share": _with(f"SELECT {q(N.SKU_CATEGORY)}, {q(N.SUM_QTY)}, "
                           f"{q(N.SUM_QTY)} / SUM({q(N.SUM_QTY)}) OVER () AS share FROM ({_Q2})"),
        "chart_traffic": _with(f"SELECT {q(N.MONTH_VN)}, {q(N.PAGE_VIEWS)}, {q(N.STORE_VISITS)} FROM ({_Q5})"),
    }
    for name in ("find_order", "find_city", "find_sku", "find_buyer"):
        out[f"indexed_{name}"] = out[name]
    for name in ("top_buyers", "top_provinces", "adjustments", "region_analysis", "product_analysis"):
        out[f"colocated_{name}"] = out[name]
    return out
