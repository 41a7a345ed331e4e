"""Incremental order cleaning and the prepared-table round trip."""

from sellerlens import names as N
from sellerlens.operators import reports as R
from sellerlens.session import scratch_path
from sellerlens.sinks.tables import read_tables, write_tables
from sellerlens.sources.files import Tables
from sellerlens.streaming.orders import start_clean_orders
from tests.conftest import rows
from tests.test_reports import ENTRIES, LINES, ORDER_SCHEMA, make


def test_incremental_cleaning_is_exactly_once(spark):
    src = scratch_path(spark, "test-stream-src")
    out = scratch_path(spark, "test-stream-out")
    ckpt = scratch_path(spark, "test-stream-ckpt")
    raw = spark.createDataFrame(LINES, ORDER_SCHEMA)
    raw.limit(3).coalesce(1).write.parquet(f"{src}/part1")
    q = start_clean_orders(spark, f"{src}/*", out, ckpt)
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 3
    raw.coalesce(1).write.parquet(f"{src}/part2")
    q = start_clean_orders(spark, f"{src}/*", out, ckpt)  # restart from the checkpoint
    q.awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 3 + len(LINES)
    batch, _ = make(spark, LINES, ENTRIES)
    assert sorted(rows(got, N.ORDER_ID, N.PROVINCE, N.SKU_CATEGORY, N.ORDER_MONTH), key=repr)[-1] \
        in rows(batch, N.ORDER_ID, N.PROVINCE, N.SKU_CATEGORY, N.ORDER_MONTH)


def test_prepared_tables_round_trip(spark):
    o, i = make(spark, LINES, ENTRIES)
    ov = spark.createDataFrame([("2024-02-01", 3, 2, 0.5)],
                               "`Ngày` string, `Lượt xem trang` bigint, "
                               "`Lượt truy cập trang Cửa hàng` bigint, `Tỷ lệ chuyển đổi` double")
    paths = write_tables(Tables(o, i, ov), scratch_path(spark, "test-tables-out"))
    t = read_tables(spark, paths)
    assert t.orders.columns == o.columns
    assert rows(R.orders_by_month(t.orders)) == rows(R.orders_by_month(o))
    assert sorted(rows(R.region_analysis(t.orders, t.income))) == sorted(rows(R.region_analysis(o, i)))
    # a month filter prunes partitions
    plan = t.orders.where(f"`{N.ORDER_MONTH}` = '2024-03'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
