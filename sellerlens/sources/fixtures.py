"""Test inputs derived from the driver's TPC-H-like tables (FIXTURES.md §3).

The marketplace exports (order lines, settlement entries, daily traffic)
are not among the driver tables, so they are derived from ``lineitem``,
``orders``, ``customer``, ``part`` and ``events`` with plain DataFrame
joins and projections. The same derivation is kept as DuckDB SQL text for
the oracle.

``materialize`` writes the three derived tables once per application to
Parquet below the shared folder (``spark.checkpoint.dir``), so that every
query afterwards reads real Parquet files with pushdown and pruning, as it
would read a seller's exports, and survives executor loss without lineage.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sellerlens import names as N
from sellerlens.session import scratch_path

# FIXED VALUES of the fixture (FIXTURES.md §3): value lists picked by key.
FIXTURE_SKUS = [
    "SC_X1", "SC_X2", "COMBO-SC-MIX", "SC_COMBO_X1", "COMBO-SCX2", "BTHP_Cay",
    "BTHP-200gr", "BTHP-COMBO+SC_X1", "UNMAPPED-1", "BTHP_COMBO_MIX",
    "BTHP-2Cay-2KhongCay", "BTHP-4Hu-Cay", "sc_x1", "BTHP003_combo_cay", None,
]
FIXTURE_PROVINCES = [
    "Tỉnh Bắc Giang", "Ha Noi", "Thành phố Hồ Chí Minh", "Ho Chi Minh City",
    "Da Nang City", " Tỉnh Lào Cai", "Can Tho", "Binh Thuan Province",
    "Hai Phong City", "Quảng Trị", "Thành Phố Cần Thơ", "Tinh Long An Province",
    "Ðắk Nông", "Tỉnh Thành phố Hà Nội", "Bình Thuận", None,
]
FIXTURE_COUNTRIES = [
    "Vietnam", "Viêt Nam", "Socialist Republic of Vietnam", "Việt Nam", "Thailand",
]

DAY_FIRST = "dd/MM/yyyy HH:mm:ss"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, key: Column) -> Column:
    """``values[key % len(values)]`` as a literal array lookup."""
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(arr, (key % len(values)).cast("int") + 1)


def _order_id(key: Column, lead: str) -> Column:
    return F.concat(F.lit(lead), F.lpad(key.cast("string"), 17, "0"))


def _days(ts: Column, n: int) -> Column:
    return ts + F.make_dt_interval(days=F.lit(n))


def fixture_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: lineitem ⋈ orders ⋈ customer ⋈ part."""
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    od = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    cu = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    pa = _read(spark, sf_dir, "part").select("p_partkey", "p_name")
    # Names are joined to narrow rows first; lines and orders meet last, merged at
    # every size, so that only key-sized rows are shuffled and none is afterwards.
    buyers = od.join(cu, F.col("o_custkey") == F.col("c_custkey"))
    products = li.join(pa, F.col("l_partkey") == F.col("p_partkey"))
    j = products.join(buyers.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    okey, odate, status = F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_orderstatus")
    fmt = lambda ts: F.date_format(ts, DAY_FIRST)
    return j.select(
        _order_id(okey, "5").alias(N.ORDER_ID),
        F.when(okey % 97 == 0, F.lit("N/A"))
         .when(okey % 103 == 0, F.lit("01/01/1500 00:00:00"))
         .when(okey % 83 == 0, F.date_format(odate, "d/M/yyyy H:m:s"))
         .otherwise(F.concat(F.lit("\t"), fmt(odate), F.lit(" "))).alias(N.CREATED_TIME),
        F.concat(fmt(_days(odate, 1)), F.lit("\n")).alias(N.PAID_TIME),
        F.concat(fmt(_days(odate, 2)), F.lit("\t")).alias(N.RTS_TIME),
        F.concat(fmt(_days(odate, 3)), F.lit("\n")).alias(N.SHIPPED_TIME),
        F.when(status == "F", F.concat(fmt(_days(odate, 5)), F.lit("\n"))).alias(N.DELIVERED_TIME),
        F.when(status == "P", F.concat(fmt(_days(odate, 1)), F.lit("\n"))).alias(N.CANCELLED_TIME),
        F.when(status == "F", "Completed").when(status == "O", "Shipped")
         .otherwise("Canceled").alias(N.ORDER_STATUS),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Error Order")
         .otherwise("Normal").alias(N.ORDER_SUBSTATUS),
        F.when(F.col("l_returnflag") == "R", "Return/Refund")
         .when(F.col("l_returnflag") == "A", "Cancel").alias(N.RETURN_TYPE),
        _pick(FIXTURE_SKUS, F.col("l_partkey")).alias(N.SELLER_SKU),
        F.col("l_partkey").cast("string").alias(N.SKU_ID),
        F.col("p_name").alias(N.PRODUCT_NAME),
        (F.col("l_quantity").cast("double") + F.when(F.col("l_partkey") % 10 == 0, 0.5).otherwise(0.0)).alias(N.QUANTITY),
        F.when(F.col("c_custkey") % 50 == 0, F.lit(None).cast("string"))
         .when(F.col("c_custkey") % 41 == 0, F.concat(F.lit("  "), F.col("c_name"), F.lit('\n"Jr", ')))
         .otherwise(F.col("c_name")).alias(N.BUYER),
        _pick(FIXTURE_PROVINCES, F.col("c_nationkey")).alias(N.PROVINCE),
        _pick(FIXTURE_COUNTRIES, F.col("c_custkey")).alias(N.COUNTRY),
    )


def fixture_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlement entries: one per order (some twice), plus adjustments.

    One scan: every order gives an array of its entries. Amounts have up to
    three decimals, some IDs are null.
    """
    od = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    okey, odate = F.col("o_orderkey"), F.col("o_orderdate")
    price = F.col("o_totalprice") + (okey % 8) * F.lit(0.001)
    fee = F.round(F.col("o_totalprice") * 0.08, 2)

    def entry(cond: Column, lead: str, typ, revenue: Column, settle_days: int) -> Column:
        settled = (F.when(okey % 89 == 0, F.lit("/"))
                    .otherwise(F.date_format(_days(odate, settle_days), "yyyy/MM/dd")))
        return F.when(cond, F.struct(
            F.when(okey % 73 != 0, _order_id(okey, lead)).alias(N.ADJUSTMENT_ID),
            F.when(okey % 71 != 0, _order_id(okey, "5")).alias(N.RELATED_ORDER_ID),
            F.lit(typ).cast("string").alias(N.TYPE),
            revenue.alias(N.TOTAL_REVENUE),
            (-fee).alias(N.TOTAL_FEES),
            (revenue - fee).alias(N.SETTLEMENT),
            settled.alias(N.SETTLED_TIME)))

    zero = F.lit(0.0)
    entries = F.array(entry(okey % 17 != 0, "5", "Order", price, 7),
                      entry(okey % 13 == 0, "5", "Order", price, 7),
                      entry(okey % 11 == 0, "7", "Logistics reimbursement", zero, 21),
                      entry(okey % 101 == 0, "7", None, zero, 30))
    return od.select(F.inline(F.filter(entries, lambda e: e.isNotNull())))


def fixture_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily traffic: views, distinct visitors and conversion per day."""
    ev = _read(spark, sf_dir, "events").select("ts", "user_id", "event_type")
    day = (F.col("ts") + F.make_ym_interval(F.lit(0), (F.col("user_id") % 6).cast("int"))).cast("date")
    views = F.count(F.when(F.col("event_type") == "view", 1))
    buys = F.count(F.when(F.col("event_type") == "purchase", 1))
    return (ev.groupBy(day.alias("_day"))
              .agg(views.alias(N.PAGE_VIEWS),
                   F.countDistinct("user_id").alias(N.STORE_VISITS),
                   F.round(buys * 1.0 / F.nullif(views, F.lit(0)), 6).alias(N.CONVERSION))
              .select(F.col("_day").cast("string").alias(N.DAY),
                      N.PAGE_VIEWS, N.STORE_VISITS, N.CONVERSION))


@dataclass(frozen=True)
class FixturePaths:
    orders: str
    income: str
    overview: str


_written: dict[tuple[str, str], FixturePaths] = {}
_lock = threading.Lock()


def _app_id(spark: SparkSession) -> str:
    try:
        return spark.sparkContext.applicationId
    except Exception:  # pragma: no cover - Spark Connect
        return spark.conf.get("spark.app.id", "app")


def materialize(spark: SparkSession, sf_dir: str) -> FixturePaths:
    """Write the three derived tables to Parquet once per application."""
    key = (_app_id(spark), sf_dir.rstrip("/"))
    with _lock:
        if key in _written:
            return _written[key]
        base = scratch_path(spark, "fixtures")
        paths = FixturePaths(f"{base}/orders.parquet", f"{base}/income.parquet",
                             f"{base}/overview.parquet")
        # Files of even size, as many as the data needs: of the lines from the
        # join's own partitions, so that their widest rows are not shuffled again.
        fixture_orders(spark, sf_dir).write.mode("overwrite").parquet(paths.orders)
        fixture_income(spark, sf_dir).hint("rebalance").write.mode("overwrite").parquet(paths.income)
        fixture_overview(spark, sf_dir).write.mode("overwrite").parquet(paths.overview)
        _written[key] = paths
        return paths


# ---------------------------------------------------------------------------
# The same derivation for DuckDB (FIXTURES.md §3), used by the oracle.
# ---------------------------------------------------------------------------

def _duck_list(values: list) -> str:
    return "[" + ",".join("CAST(NULL AS VARCHAR)" if v is None else "'" + v.replace("'", "''") + "'"
                          for v in values) + "]"


DUCK_ORDERS = f"""
SELECT concat('5', lpad(CAST(o_orderkey AS VARCHAR),17,'0')) AS "Order ID",
 CASE WHEN o_orderkey % 97 = 0 THEN 'N/A' WHEN o_orderkey % 103 = 0 THEN '01/01/1500 00:00:00' WHEN o_orderkey % 83 = 0 THEN strftime(o_orderdate,'%-d/%-m/%Y %-H:%-M:%-S') ELSE concat(CAST(chr(9) AS VARCHAR), strftime(o_orderdate,'%d/%m/%Y %H:%M:%S'), ' ') END AS "Created Time",
 concat(strftime((o_orderdate + to_days(1)),'%d/%m/%Y %H:%M:%S'), CAST(chr(10) AS VARCHAR)) AS "Paid Time",
 concat(strftime((o_orderdate + to_days(2)),'%d/%m/%Y %H:%M:%S'), CAST(chr(9) AS VARCHAR)) AS "RTS Time",
 concat(strftime((o_orderdate + to_days(3)),'%d/%m/%Y %H:%M:%S'), CAST(chr(10) AS VARCHAR)) AS "Shipped Time",
 CASE WHEN o_orderstatus='F' THEN concat(strftime((o_orderdate + to_days(5)),'%d/%m/%Y %H:%M:%S'), CAST(chr(10) AS VARCHAR)) END AS "Delivered Time",
 CASE WHEN o_orderstatus='P' THEN concat(strftime((o_orderdate + to_days(1)),'%d/%m/%Y %H:%M:%S'), CAST(chr(10) AS VARCHAR)) END AS "Cancelled Time",
 CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Shipped' ELSE 'Canceled' END AS "Order Status",
 CASE WHEN o_orderpriority='1-URGENT' THEN 'Error Order' ELSE 'Normal' END AS "Order Substatus",
 CASE l_returnflag WHEN 'R' THEN 'Return/Refund' WHEN 'A' THEN 'Cancel' END AS "Cancelation/Return Type",
 list_extract({_duck_list(FIXTURE_SKUS)}, CAST(l_partkey % 15 AS INT)+1) AS "Seller SKU",
 CAST(l_partkey AS VARCHAR) AS "SKU ID", p_name AS "Product Name",
 CAST(l_quantity AS DOUBLE) + CASE WHEN l_partkey % 10 = 0 THEN 0.5e0 ELSE 0e0 END AS "Quantity",
 CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 41 = 0 THEN concat('  ', c_name, chr(10), '"Jr", ') ELSE c_name END AS "Buyer Username",
 list_extract({_duck_list(FIXTURE_PROVINCES)}, CAST(c_nationkey % 16 AS INT)+1) AS "Province",
 list_extract({_duck_list(FIXTURE_COUNTRIES)}, CAST(c_custkey % 5 AS INT)+1) AS "Country"
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN part ON l_partkey=p_partkey
"""

_DUCK_INCOME_PART = """
SELECT CASE WHEN o_orderkey % 73 <> 0 THEN concat('{lead}', lpad(CAST(o_orderkey AS VARCHAR),17,'0')) END AS "Order/adjustment ID",
 CASE WHEN o_orderkey % 71 <> 0 THEN concat('5', lpad(CAST(o_orderkey AS VARCHAR),17,'0')) END AS "Related order ID", {typ} AS "Type",
 {rev} AS "Total revenue", -round(o_totalprice*0.08,2) AS "Total fees",
 {rev}-round(o_totalprice*0.08,2) AS "Total settlement amount",
 CASE WHEN o_orderkey % 89 = 0 THEN '/' ELSE strftime((o_orderdate + to_days({days})),'%Y/%m/%d') END AS "Order settled time"
 FROM orders WHERE {cond}"""

DUCK_INCOME = "\nUNION ALL\n".join([
    _DUCK_INCOME_PART.format(lead="5", typ="'Order'", rev="(o_totalprice + (o_orderkey % 8) * 0.001e0)", days=7, cond="o_orderkey % 17 <> 0"),
    _DUCK_INCOME_PART.format(lead="5", typ="'Order'", rev="(o_totalprice + (o_orderkey % 8) * 0.001e0)", days=7, cond="o_orderkey % 13 = 0"),
    _DUCK_INCOME_PART.format(lead="7", typ="'Logistics reimbursement'", rev="0.0e0", days=21, cond="o_orderkey % 11 = 0"),
    _DUCK_INCOME_PART.format(lead="7", typ="CAST(NULL AS VARCHAR)", rev="0.0e0", days=30, cond="o_orderkey % 101 = 0"),
])

DUCK_OVERVIEW = """
SELECT CAST(CAST(ts + to_months(CAST(user_id % 6 AS INT)) AS DATE) AS VARCHAR) AS "Ngày",
 count(CASE WHEN event_type='view' THEN 1 END) AS "Lượt xem trang",
 count(DISTINCT user_id) AS "Lượt truy cập trang Cửa hàng",
 round(count(CASE WHEN event_type='purchase' THEN 1 END)*1.0e0/nullif(count(CASE WHEN event_type='view' THEN 1 END),0),6) AS "Tỷ lệ chuyển đổi"
 FROM events GROUP BY CAST(ts + to_months(CAST(user_id % 6 AS INT)) AS DATE)
"""
