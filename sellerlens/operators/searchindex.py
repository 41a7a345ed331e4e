"""Value index for the searches P1 … P4 on written tables.

A search on a large store should open the files that hold its value, not scan
a column. ``build_index`` reads the searched columns of the written tables
once and writes

* ``files`` – (file, f, side, rows): the tables' files and their 64-bit hashes;
* ``values`` – (column, h, f): which files hold a value, both as 64-bit hashes,
  so that an entry is 16 bytes however long texts and paths are. Values are
  dealt into buckets by hash, one folder a bucket, so that a look-up opens one
  bucket's files;
* ``provinces`` – the distinct provinces;
* ``grams`` – (gram, value): these by their lower-case three-character pieces,
  for ``ILIKE '%x%'``.

A search looks its value up, reads the files found and runs the unindexed
search on them, so its rows are the same by construction: files left out hold
no such value, and a file found by an equal hash alone gives no row. The searched columns are equality keys, null matches nothing
and is not indexed. The index belongs to the files it was built from; after
the tables are written again it must be built again (a file that is missing
raises).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sellerlens import names as N
from sellerlens.operators import search
from sellerlens.operators.search import city_condition
from sellerlens.sinks.tables import TablePaths, read_tables

c = N.c

BUCKET_VALUES = 1_000_000      # rows of a table that a bucket stands for: more entries than a column has there
FEW_ORDERS = 1_000             # matched orders whose entries are looked up, too
GRAM = 3

ORDER_KEYS = (N.ORDER_ID, N.SKU_ID, N.BUYER, N.PROVINCE)


@dataclass(frozen=True)
class SearchIndex:
    """An index below ``path`` over the tables at ``tables``."""
    path: str
    tables: TablePaths
    buckets: int


def _bucket(h, buckets: int):
    return F.pmod(h, F.lit(buckets)).cast("int")


def _hash(value):
    return F.xxhash64(value.cast("string"))


def _places(df: DataFrame, column: str) -> DataFrame:
    """Distinct (column, h, f) of the non-null values of one column. Columns
    are taken one by one: a task then combines numbers of one column only."""
    t = df.where(c(column).isNotNull()).select(_hash(c(column)).alias("h"), F.xxhash64("_metadata.file_path").alias("f"))
    return t.distinct().select(F.lit(column).alias("column"), "h", "f")


def _files(df: DataFrame, side: str) -> DataFrame:
    t = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    return t.select("file", F.xxhash64("file").alias("f"), F.lit(side).alias("side"), "rows")


def grams(value) -> DataFrame:
    """Column: the distinct lower-case pieces of a text."""
    low = F.lower(value)
    at = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda p: F.substring(low, p, F.lit(GRAM))))


def build_index(spark: SparkSession, tables: TablePaths, path: str, mode: str = "overwrite") -> SearchIndex:
    """Index the tables written by ``sinks.tables.write_tables`` below ``path``."""
    b = path.rstrip("/")
    orders, income = spark.read.parquet(tables.orders), spark.read.parquet(tables.income)
    _files(orders, "orders").unionByName(_files(income, "income")).write.mode(mode).parquet(f"{b}/files")
    rows = spark.read.parquet(f"{b}/files").groupBy("side").agg(F.sum("rows").alias("rows")).agg(F.max("rows")).first()[0] or 0
    buckets = max(1, -(-rows // BUCKET_VALUES))
    found = [_places(orders, x) for x in ORDER_KEYS] + [_places(income, N.RELATED_ORDER_ID)]
    keyed = reduce(DataFrame.unionByName, found).withColumn("bucket", _bucket(F.col("h"), buckets))
    (keyed.repartition("column", "bucket").sortWithinPartitions("column", "bucket", "h")
          .write.mode(mode).partitionBy("column", "bucket").parquet(f"{b}/values"))
    known = orders.where(c(N.PROVINCE).isNotNull()).select(c(N.PROVINCE).cast("string").alias("value")).distinct()
    known.write.mode(mode).parquet(f"{b}/provinces")
    values = spark.read.parquet(f"{b}/provinces")
    values.select(F.explode(grams(F.col("value"))).alias("gram"), "value").sort("gram").write.mode(mode).parquet(f"{b}/grams")
    return SearchIndex(b, tables, buckets)


def files_of(spark: SparkSession, index: SearchIndex, column: str, values: list[str]) -> list[str]:
    """Files that hold one of ``values``; as many as the table has, at most."""
    if not values:
        return []
    t = spark.read.parquet(f"{index.path}/values").where(F.col("column") == column)
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias("v")).select(_hash(F.col("v")).alias("h"))
    keys = wanted.select("h", _bucket(F.col("h"), index.buckets).alias("at")).distinct().collect()
    t = t.where(F.col("bucket").isin(sorted({r["at"] for r in keys})) & F.col("h").isin([r["h"] for r in keys]))
    side = "income" if column == N.RELATED_ORDER_ID else "orders"
    files = spark.read.parquet(f"{index.path}/files").where(F.col("side") == side)
    return sorted(r[0] for r in files.join(t.select("f").distinct(), "f", "left_semi").select("file").collect())


def provinces_like(spark: SparkSession, index: SearchIndex, text: str) -> list[str]:
    """Distinct provinces that ``ILIKE '%text%'`` matches. The pieces of the
    text between wildcards choose candidates, which are then compared."""
    like = city_condition(text)
    pieces = {p[i:i + GRAM] for p in text.lower().replace("_", "%").split("%") for i in range(len(p) - GRAM + 1)}
    t = spark.read.parquet(f"{index.path}/grams")
    if pieces:
        t = (t.where(F.col("gram").isin(sorted(pieces))).groupBy("value").agg(F.count("*").alias("n"))
              .where(F.col("n") == len(pieces)))
    else:                      # too short a text: all values, also those without a piece
        t = spark.read.parquet(f"{index.path}/provinces")
    t = t.select(F.col("value").alias(N.PROVINCE)).distinct().where(like)
    return sorted(r[0] for r in t.collect())


def _only(spark: SparkSession, whole: DataFrame, base: str, files: list[str]) -> DataFrame:
    """The rows of a written table in ``files``."""
    if not files:
        return whole.where(F.lit(False))
    return spark.read.schema(whole.schema).option("basePath", base).parquet(*files).select(*[c(x) for x in whole.columns])


def _tables(spark: SparkSession, index: SearchIndex, column: str, values: list[str],
            ids: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Orders and entries to search: the files that hold a value, and those
    with entries of the matched orders, if these are few."""
    t = read_tables(spark, index.tables)
    orders = _only(spark, t.orders, index.tables.orders, files_of(spark, index, column, values))
    if ids is None:
        got = orders.where(c(column).isin(values)).select(c(N.ORDER_ID)).distinct().limit(FEW_ORDERS + 1).collect()
        ids = [r[0] for r in got if r[0] is not None] if len(got) <= FEW_ORDERS else None
    if ids is None:
        return orders, t.income
    return orders, _only(spark, t.income, index.tables.income, files_of(spark, index, N.RELATED_ORDER_ID, ids))


def find_by_order(spark: SparkSession, index: SearchIndex, order_id: str) -> DataFrame:
    """P1 through the index."""
    return search.find_by_order(*_tables(spark, index, N.ORDER_ID, [order_id], [order_id]), order_id)


def find_by_city(spark: SparkSession, index: SearchIndex, city: str) -> DataFrame:
    """P2 through the index (``%`` and ``_`` are wildcards)."""
    return search.find_by_city(*_tables(spark, index, N.PROVINCE, provinces_like(spark, index, city)), city)


def find_by_sku(spark: SparkSession, index: SearchIndex, sku_id: str) -> DataFrame:
    """P3 through the index."""
    return search.find_by_sku(*_tables(spark, index, N.SKU_ID, [sku_id]), sku_id)


def find_by_buyer(spark: SparkSession, index: SearchIndex, buyer: str) -> DataFrame:
    """P4 through the index."""
    return search.find_by_buyer(*_tables(spark, index, N.BUYER, [buyer]), buyer)
