"""Exact distinct orders at every grain from one stored roll-up (Q1, Q9).

Distinct counts do not add up: an order with lines of two categories counts in
both, once in their total. So the roll-up keeps sets. Orders are numbered
densely from 0, by month and ID, and every cell (month, province, category)
stores the numbers of its orders as bitmaps of 32,768 bits, one for each slot
of numbers it touches. A coarser grain is the union of its cells' bitmaps, slot
by slot, so any combination of the three columns, and the grand total, is
counted from the stored cells alone, without the order lines.

As numbers follow months, a cell touches few slots; a bitmap with few orders is
mostly zeros, which Parquet's and the shuffle's compression take out. Unions
are combined inside tasks, a slot's bitmap is 4 KB, and no grain holds more
than one of them a slot and group.

Defined cases: lines without an order ID count no order, but their cell is
there (with zero); null column values are groups of their own; an empty table
has an empty roll-up, and its grand total is zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sellerlens import names as N
from sellerlens.plans.numbering import numbered
from sellerlens.session import scratch_path

GRAIN = (N.ORDER_MONTH, N.PROVINCE, N.SKU_CATEGORY)
SLOT, BITS = "slot", "bits"


def number_orders(orders: DataFrame) -> DataFrame:
    """``_oid`` and its ``number``: dense, ascending by first month, then ID."""
    first = (orders.where(N.c(N.ORDER_ID).isNotNull()).groupBy(N.c(N.ORDER_ID).cast("string").alias("_oid"))
                   .agg(F.min(N.c(N.ORDER_MONTH)).alias("_month")))
    return numbered(first, [F.asc_nulls_last("_month"), F.asc("_oid")], "number").drop("_month")


def write_rollup(spark: SparkSession, orders: DataFrame, path: str) -> DataFrame:
    """Write the roll-up of the order lines to ``path`` and read it back.

    The lines are cleaned once and written narrow; orders are numbered from
    that. A bitmap takes an order any number of times, so equal lines need no
    shuffle of their own; lines without an ID have no number to look up."""
    once = scratch_path(spark, "cells")
    orders.select(*[N.c(x) for x in GRAIN], N.c(N.ORDER_ID).cast("string").alias(N.ORDER_ID)).write.parquet(once)
    lines = spark.read.parquet(once)
    n = F.col("number") + 1        # Spark's slots begin at one
    numbers = number_orders(lines)
    known = lines.join(numbers, N.c(N.ORDER_ID) == F.col("_oid")).select(*[N.c(x) for x in GRAIN], "number")
    rest = lines.where(N.c(N.ORDER_ID).isNull()).select(*[N.c(x) for x in GRAIN], F.lit(None).cast("long").alias("number"))
    (known.unionByName(rest)
          .select(*[N.c(x) for x in GRAIN], F.bitmap_bucket_number(n).alias(SLOT), F.bitmap_bit_position(n).alias("_at"))
          .groupBy(*[N.c(x) for x in GRAIN], SLOT).agg(F.bitmap_construct_agg("_at").alias(BITS))
          .write.mode("error").parquet(path))
    return spark.read.parquet(path)


def distinct_orders(rollup: DataFrame, grain: tuple[str, ...] = ()) -> DataFrame:
    """Distinct orders per value of the ``grain`` columns (some of ``GRAIN``;
    none: the grand total), from the roll-up."""
    unknown = set(grain) - set(GRAIN)
    if unknown:
        raise ValueError(f"not in the roll-up: {sorted(unknown)}")
    keys = [N.c(x) for x in grain]
    slots = rollup.groupBy(*keys, SLOT).agg(F.bitmap_or_agg(BITS).alias(BITS))
    count = F.coalesce(F.sum(F.bitmap_count(BITS)), F.lit(0)).alias(N.N_ORDERS)
    out = slots.groupBy(*keys).agg(count)
    return out.orderBy(*[F.asc_nulls_last(N.c(x)) for x in grain]) if grain else out
