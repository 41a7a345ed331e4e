import pytest
from pyspark.sql import functions as F

from sellerlens import catalog
from sellerlens import names as N
from sellerlens.operators import search, searchindex as X
from sellerlens.sinks.tables import read_tables, write_tables
from tests.conftest import SF_SMALL, rows

NAMES = ("order", "city", "sku", "buyer")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    base = f"file://{tmp_path_factory.mktemp('store')}"
    t = catalog.tables(spark, SF_SMALL)
    paths = write_tables(t, base)
    return read_tables(spark, paths), X.build_index(spark, paths, f"{base}/index")


def both(spark, store, kind, value):
    t, index = store
    return (getattr(search, f"find_by_{kind}")(t.orders, t.income, value),
            getattr(X, f"find_by_{kind}")(spark, index, value))


def some_values(t, column, n=2):
    return [r[0] for r in t.orders.where(f"`{column}` IS NOT NULL").groupBy(f"`{column}`").count()
            .orderBy("count", column).limit(n).collect()]


@pytest.mark.parametrize("kind, column", [("order", N.ORDER_ID), ("sku", N.SKU_ID), ("buyer", N.BUYER)])
def test_same_rows_from_fewer_files(spark, store, kind, column):
    t, index = store
    for value in [*some_values(t, column), "x' OR '1'='1", ""]:
        plain, indexed = both(spark, store, kind, value)
        assert indexed.columns == plain.columns and sorted(rows(indexed), key=repr) == sorted(rows(plain), key=repr)
        holding = {r[0] for r in t.orders.where(F.col(f"`{column}`") == value).select("_metadata.file_path").distinct().collect()}
        opened = {f for f in indexed.inputFiles() if "/orders/" in f}
        assert len(opened) == len(holding) < len(t.orders.inputFiles())


def test_provinces_by_pieces(spark, store):
    t, index = store
    known = t.orders.select(N.PROVINCE).distinct().cache()
    for text in ("đà nẵng", "ĐÀ N", "hồ chí", "nội", "a", "", "%", "h_ n%i", "à_n", "\\", "không có"):
        want = {r[0] for r in known.where(search.city_condition(text)).collect()}
        assert set(X.provinces_like(spark, index, text)) == want, text


@pytest.mark.parametrize("text", ["ĐÀ N", "không có", "%"])
def test_same_rows_of_a_city(spark, store, text):
    plain, indexed = both(spark, store, "city", text)
    assert sorted(rows(indexed), key=repr) == sorted(rows(plain), key=repr)


def test_many_buckets_and_many_orders(spark, store, tmp_path, monkeypatch):
    t, index = store
    monkeypatch.setattr(X, "BUCKET_VALUES", 500)
    monkeypatch.setattr(X, "FEW_ORDERS", 2)
    many = X.build_index(spark, index.tables, f"file://{tmp_path}")
    assert many.buckets > 5
    for value in some_values(t, N.BUYER, 2):
        plain = search.find_by_buyer(t.orders, t.income, value)
        assert sorted(rows(X.find_by_buyer(spark, many, value)), key=repr) == sorted(rows(plain), key=repr)
    look = spark.read.parquet(f"{many.path}/values").where((F.col("column") == N.BUYER) & (F.col("bucket") == 3))
    assert "PartitionFilters: [isnotnull(column" in look._jdf.queryExecution().executedPlan().toString()


def test_bloom_filters_are_written(spark, store):
    import glob
    import pyarrow.parquet as pq
    t, index = store
    file = next(f for f in glob.glob(index.tables.orders.removeprefix("file://") + "/*/*.parquet"))
    group = pq.ParquetFile(file).metadata.row_group(0)
    names = [group.column(i).path_in_schema for i in range(group.num_columns)]
    assert N.SKU_ID in names
    raw = open(file, "rb").read()
    assert len(raw) > sum(group.column(i).total_compressed_size for i in range(group.num_columns)) + 1024


def test_entries_are_numbers_built_column_by_column(spark, store):
    t, index = store
    values = spark.read.parquet(f"{index.path}/values")
    assert {k: v for k, v in values.dtypes if k in ("h", "f")} == {"h": "bigint", "f": "bigint"} and "value" not in values.columns
    lines = spark.read.parquet(index.tables.orders)
    plan = X._places(lines, N.SKU_ID)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 1
    for column in (N.SKU_ID, N.PROVINCE):
        have = values.where(F.col("column") == column)
        want = lines.where(F.col(f"`{column}`").isNotNull()).select(column, "_metadata.file_path").distinct().count()
        assert have.count() == want == have.distinct().count()
