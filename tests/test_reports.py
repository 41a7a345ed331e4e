"""Reports on small hand-made inputs: fan-out, nulls, ordering, properties."""

from sellerlens import names as N
from sellerlens.operators import chartdata as V
from sellerlens.operators import cleaning as C
from sellerlens.operators import income as I
from sellerlens.operators import reports as R
from tests.conftest import rows

ORDER_SCHEMA = ", ".join(f"`{c}` {'bigint' if c == N.QUANTITY else 'string'}" for c in N.ORDER_COLUMNS)
INCOME_SCHEMA = ("`Order/adjustment ID` string, `Related order ID` string, `Type` string, "
                 "`Total revenue` double, `Total fees` double, `Total settlement amount` double, "
                 "`Order settled time` string")


def order_line(oid, created="01/02/2024 10:00:00", status="Completed", sku="SC_X1", qty=1,
               buyer="b1", province="Ha Noi", ret=None, sub="Normal", product="p"):
    vals = {N.ORDER_ID: oid, N.CREATED_TIME: created, N.ORDER_STATUS: status,
            N.SELLER_SKU: sku, N.QUANTITY: qty, N.BUYER: buyer, N.PROVINCE: province,
            N.RETURN_TYPE: ret, N.ORDER_SUBSTATUS: sub, N.PRODUCT_NAME: product,
            N.COUNTRY: "Vietnam", N.SKU_ID: "1"}
    return tuple(vals.get(c) for c in N.ORDER_COLUMNS)


def make(spark, lines, entries):
    o = C.clean_orders(spark.createDataFrame(lines, ORDER_SCHEMA))
    i = I.classify_income(spark.createDataFrame(entries, INCOME_SCHEMA))
    return o, i


def entry(rid, adj=None, typ="Order", rev=100.0, settled="2024/02/10"):
    return (adj or rid, rid, typ, rev, -8.0, rev - 8.0, settled)


LINES = [
    order_line("1", qty=2), order_line("1", qty=3, ret="Return/Refund"),
    order_line("2", status="Canceled", province="Da Nang", buyer="b2"),
    order_line("3", created="N/A", buyer=None),
    order_line(None, created="05/03/2024 00:00:00"),
    order_line("4", created="05/03/2024 00:00:00", sub="Error Order", sku=None),
]
ENTRIES = [entry("1"), entry("1", adj="71", typ="Fee", rev=0.0), entry("2", rev=50.0), entry("4", rev=10.0)]


def test_orders_by_month_nulls(spark):
    o, _ = make(spark, LINES, ENTRIES)
    got = rows(R.orders_by_month(o))
    # months ascending, the unparseable month last; null IDs not counted
    assert got == [("2024-02", 2, 1, 1), ("2024-03", 1, 0, 1), (None, 1, 0, 1)]


def test_sku_summary_counts_lines(spark):
    o, _ = make(spark, LINES, ENTRIES)
    got = rows(R.sku_summary(o))
    assert got == [("SC-450g", 8, 4)]  # lines, not orders; the null-ID line counts


def test_sku_monthly_sums_to_summary(spark):
    o, _ = make(spark, LINES, ENTRIES)
    monthly = rows(R.sku_monthly(o), N.PRODUCT_KIND, N.TOTAL_QUANTITY, N.COMPLETED_ORDERS)
    summary = rows(R.sku_summary(o))
    assert sum(m[1] for m in monthly) == sum(s[1] for s in summary)
    assert sum(m[2] for m in monthly) == sum(s[2] for s in summary)


def test_top_buyers_counts_joined_rows(spark):
    o, i = make(spark, LINES, ENTRIES)
    # order 1: 2 completed lines x 2 entries, order 4: 1 x 1 -> 5 joined rows
    assert rows(R.top_buyers(o, i)) == [("b1", 5)]


def test_top_k_limit_and_ties(spark):
    lines = [order_line(str(k), buyer=f"b{k % 3}") for k in range(12)]
    ents = [entry(str(k)) for k in range(12)]
    o, i = make(spark, lines, ents)
    got = rows(R.top_buyers(o, i, k=2))
    assert got == [("b0", 4), ("b1", 4)]  # ties broken by the key


def test_region_analysis(spark):
    o, i = make(spark, LINES, ENTRIES)
    got = {r[0]: r[1:] for r in rows(R.region_analysis(o, i))}
    # Hà Nội: orders 1 and 4 joined; revenue 2 lines x (100 + 0) + 1 line x 10
    # return share: order 1 has 2 lines x 2 entries, 1 returned line -> 2/4; order 4 -> 0/1
    assert got["Hà Nội"] == (2, 210.0, 2 / 5)
    assert got["Đà Nẵng"] == (1, 50.0, 0.0)


def test_product_analysis(spark):
    o, i = make(spark, LINES, ENTRIES)
    got = rows(R.product_analysis(o, i))
    assert got[0] == ("p", "SC_X1", "SC-450g", 2, 250.0, 2)


def test_adjustments_and_errors(spark):
    o, i = make(spark, LINES, ENTRIES)
    assert rows(R.adjustments(o, i), N.ORDER_ID, N.TYPE) == [("1", "Fee"), ("1", "Fee")]
    assert rows(R.error_by_month(o)) == [("2024-03", 1)]
    assert [r[N.ORDER_ID] for r in R.error_list(o).collect()] == ["4"]


def test_income_by_month_and_text(spark):
    _, i = make(spark, LINES, ENTRIES)
    assert rows(R.income_by_month(i)) == [("2024-02", 160.0, 128.0)]
    assert rows(R.income_by_month_text(i)) == [("2024-02", "160 ₫", "128 ₫")]


def test_traffic_by_month(spark):
    ov = spark.createDataFrame(
        [("2024-01-01", 10, 2, 0.1), ("2024-01-02", 20, 3, 0.2), ("2024-02-01", 5, 1, None)],
        "`Ngày` string, `Lượt xem trang` bigint, `Lượt truy cập trang Cửa hàng` bigint, `Tỷ lệ chuyển đổi` double")
    got = rows(R.traffic_by_month(ov))
    assert got[0][:3] == ("2024-01", 30, 5) and abs(got[0][3] - 0.15) < 1e-15
    assert got[1] == ("2024-02", 5, 1, None)


def test_chart_frames(spark):
    o, i = make(spark, LINES, ENTRIES)
    long = rows(V.chart_orders_long(o))
    assert len(long) == 3 * 3 and long[0][0] == "2024-02"
    share = rows(V.sku_share(o))
    assert abs(sum(r[2] for r in share) - 1.0) < 1e-12
    assert rows(V.chart_income_long(i)) == [("2024-02", N.REVENUE, 160.0), ("2024-02", N.NET_REVENUE, 128.0)]


def test_money_text_columns(spark):
    o, i = make(spark, LINES, ENTRIES)
    got = rows(R.with_money_text(R.region_analysis(o, i)), N.PROVINCE, N.REVENUE)
    assert ("Hà Nội", "210 ₫") in got


def test_traffic_lenient_day(spark):
    ov = spark.createDataFrame(
        [("2024-01-01", 10, 2, 0.1), ("not a day", 20, 3, 0.2)],
        "`Ngày` string, `Lượt xem trang` bigint, `Lượt truy cập trang Cửa hàng` bigint, `Tỷ lệ chuyển đổi` double")
    got = rows(R.traffic_by_month(ov, lenient=True), N.MONTH_VN, N.PAGE_VIEWS)
    assert got == [("2024-01", 10), (None, 20)]


def test_lookup_join_dictionary(spark):
    from sellerlens.functions.mapping import PROVINCE_MAP, lookup_join
    d = spark.createDataFrame(list(PROVINCE_MAP.items()), "key string, value string")
    df = spark.createDataFrame([("Ha Noi",), ("Nowhere",), (None,)], "Province string")
    got = rows(lookup_join(df, "Province", d))
    assert sorted(got, key=repr) == sorted([("Hà Nội",), ("Nowhere",), (None,)], key=repr)
