"""Distinct orders of every grain from the stored roll-up."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sellerlens import catalog, names as N
from sellerlens.operators import distinct as D
from tests.conftest import SF_SMALL, rows

SCHEMA = f"`{N.ORDER_ID}` string, `{N.ORDER_MONTH}` string, `{N.PROVINCE}` string, `{N.SKU_CATEGORY}` string"
GRAINS = [g for k in range(4) for g in combinations(D.GRAIN, k)]


def plain(orders, grain):
    return sorted(map(str, rows(orders.groupBy(*[N.c(x) for x in grain])
                                .agg(F.countDistinct(N.c(N.ORDER_ID)).alias(N.N_ORDERS)))))


def test_every_grain_equals_count_distinct(spark, tmp_path):
    orders = catalog.tables(spark, SF_SMALL).orders
    up = D.write_rollup(spark, orders, str(tmp_path / "r"))
    for grain in GRAINS:
        assert sorted(map(str, rows(D.distinct_orders(up, grain)))) == plain(orders, grain), grain
    with pytest.raises(ValueError):
        D.distinct_orders(up, (N.BUYER,))


def test_numbers_are_dense_over_many_slots_and_partitions(spark, tmp_path):
    orders = spark.range(100_000).selectExpr(
        f"CAST(id % 80000 AS string) AS `{N.ORDER_ID}`", f"CONCAT('2024-0', id % 7 + 1) AS `{N.ORDER_MONTH}`",
        f"IF(id % 3 = 0, 'hot', NULL) AS `{N.PROVINCE}`", f"CAST(id % 2 AS string) AS `{N.SKU_CATEGORY}`")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        given = D.number_orders(orders)
        assert given.agg(F.count("*"), F.countDistinct("number"), F.min("number"), F.max("number")).first() == (80000, 80000, 0, 79999)
        up = D.write_rollup(spark, orders, str(tmp_path / "r"))
        assert up.select(D.SLOT).distinct().count() == 3
        for grain in GRAINS:
            assert sorted(map(str, rows(D.distinct_orders(up, grain)))) == plain(orders, grain), grain
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_rows_without_id_and_empty_tables(spark, tmp_path):
    given = [(None, "2024-01", "p", None), ("a", None, "p", "x"), ("a", None, "p", "y"), ("a", None, "p", "y"), ("", "2024-02", None, "x")]
    orders = spark.createDataFrame(given, SCHEMA)
    up = D.write_rollup(spark, orders, str(tmp_path / "r"))
    assert rows(D.distinct_orders(up)) == [(2,)]
    assert rows(D.distinct_orders(up, (N.ORDER_MONTH,))) == [("2024-01", 0), ("2024-02", 1), (None, 1)]
    none = D.write_rollup(spark, orders.limit(0), str(tmp_path / "e"))
    assert rows(D.distinct_orders(none)) == [(0,)] and rows(D.distinct_orders(none, D.GRAIN)) == []


def test_lines_are_read_once(spark, tmp_path, monkeypatch):
    given = [("a", "2024-01", "p", "x"), ("a", "2024-01", "p", "y"), ("b", "2024-02", None, "x"), (None, "2024-02", "p", "x")]
    spark.createDataFrame(given, SCHEMA).write.parquet(str(tmp_path / "lines"))
    seen, number = [], D.number_orders
    monkeypatch.setattr(D, "number_orders", lambda df: seen.append(df.inputFiles()) or number(df))
    up = D.write_rollup(spark, spark.read.parquet(str(tmp_path / "lines")), str(tmp_path / "r"))
    assert seen and not [f for f in seen[0] if str(tmp_path) in f]
    assert rows(D.distinct_orders(up, (N.ORDER_MONTH,))) == [("2024-01", 1), ("2024-02", 1)]
