"""Order lines and settlement entries stored together by order ID.

The join reports meet lines and entries on the order ID. Stored as two tables
of as many buckets, dealt and sorted by that ID, neither side is shuffled for
the join again: a task reads one bucket of both. Written once, read by every
join report.

A bucket is one task, so an ID with more rows than an average bucket holds (an
order of bulk corrections, say) is stored apart, in two plain tables, where the
usual plan reduces it inside many tasks. There are at most as many such IDs as
buckets, whatever the data. Rows without an ID, which join nothing, are
there, too. No ID is in both parts, so a report over the two is the report
over all (``plans.joins``).

The tables are of the session's catalog and have their files below ``base``;
``attach`` makes a store known to another application's catalog.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sellerlens import names as N
from sellerlens.operators.income import classify_income
from sellerlens.plans.joins import Parts
from sellerlens.sources.files import Tables

# A bucket is sorted whole by one task: half a million lines of some 600 bytes
# stay in its memory. Up to MERGED buckets a map task writes its rows straight to
# one file a bucket, beyond it holds and sorts them; so there are no more
# than MERGED buckets as long as a bucket has at most MOST_ROWS rows.
ROWS_PER_BUCKET = 500_000
MOST_ROWS = 1_400_000
MERGED = 200
LEAST_BUCKETS = 8
SIDES = {"orders": N.ORDER_ID, "income": N.RELATED_ORDER_ID}


@dataclass(frozen=True)
class Colocated:
    """Lines and entries dealt alike by order ID, and those of hot IDs."""
    orders: DataFrame
    income: DataFrame
    hot_orders: DataFrame
    hot_income: DataFrame

    @property
    def parts(self) -> Parts:
        return [(self.orders, self.income), (self.hot_orders, self.hot_income)]


def _counts(df: DataFrame, key: str) -> DataFrame:
    return df.where(N.c(key).isNotNull()).groupBy(N.c(key).alias("id")).agg(F.count(F.lit(1)).alias("n"))


def bucket_count(rows: int) -> int:
    """Buckets for so many lines and entries together."""
    return max(LEAST_BUCKETS, min(MERGED, -(-rows // ROWS_PER_BUCKET)), -(-rows // MOST_ROWS))


def write_colocated(spark: SparkSession, tables: Tables, base: str, name: str, buckets: int | None = None) -> Colocated:
    """Store both tables below ``base`` as ``<name>_orders`` and ``<name>_income``.

    ``buckets`` follows from the number of rows unless given; both tables must
    not exist yet. Labels depend only on entries of the same related ID, so the
    entries apart and the others are classified each for themselves where
    ``tables`` has them unclassified."""
    base = base.rstrip("/")
    sides = {"orders": tables.orders, "income": tables.income}
    counts = None
    for side, df in sides.items():
        one = _counts(df, SIDES[side])
        counts = one if counts is None else counts.unionByName(one)
    counts.groupBy("id").agg(F.sum("n").alias("n")).write.parquet(f"{base}/ids")
    ids = spark.read.parquet(f"{base}/ids")
    rows = ids.agg(F.sum("n")).first()[0] or 0
    buckets = buckets or bucket_count(rows)
    # Fewer than ``buckets`` IDs can have more than their share of the rows.
    hot = F.broadcast(ids.where(F.col("n") > rows / buckets).select(F.col("id").alias("_hot_id")))
    given = {"orders": (tables.orders, lambda t: t),
             "income": (tables.income, lambda t: t) if tables.entries is None else (tables.entries, classify_income)}
    for side, (df, whole) in given.items():
        key = SIDES[side]
        marked = df.join(hot, N.c(key) == F.col("_hot_id"), "left")
        apart = F.col("_hot_id").isNotNull() | N.c(key).isNull()
        whole(marked.where(apart).drop("_hot_id")).write.parquet(f"{base}/hot_{side}")
        # Dealt by the same hash as the buckets: one file and one task each.
        (whole(marked.where(~apart).drop("_hot_id")).repartition(buckets, N.c(key))
               .write.bucketBy(buckets, key).sortBy(key).format("parquet")
               .option("path", f"{base}/{side}").saveAsTable(f"{name}_{side}"))
    return _open(spark, base, name)


def attach(spark: SparkSession, base: str, name: str, buckets: int) -> Colocated:
    """A store of ``buckets`` buckets written by another application."""
    base = base.rstrip("/")
    for side, key in SIDES.items():
        schema = spark.read.parquet(f"{base}/{side}").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name}_{side} ({columns}) USING parquet "
                  f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {int(buckets)} BUCKETS LOCATION '{base}/{side}'")
    return _open(spark, base, name)


def _open(spark: SparkSession, base: str, name: str) -> Colocated:
    return Colocated(*[spark.table(f"{name}_{side}") for side in SIDES],
                     *[spark.read.parquet(f"{base}/hot_{side}") for side in SIDES])
