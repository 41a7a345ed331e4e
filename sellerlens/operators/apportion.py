"""Settlements shared out to order lines (largest remainder).

Joining lines to entries counts an order's settlement once per line, so money
summed over the join is too much. Here each order's settled total is divided
over its lines in whole smallest units, in proportion to their quantity: every
line gets its share rounded down, and the units left go one each to the lines
with the largest remainders (equal remainders: by the lines' columns in order,
nulls first). All shares of an order add up to its total exactly, and so do
group totals of any kind.

Which lines get a unit more is decided per order on its classes of equal
remainder: those above the boundary all get one, those below none. Only lines of
a boundary class that is served in part are told apart by their columns; their
places come from one range-partitioned sort, counted across partitions. An order
of more than ``MANY_CLASSES`` weights has all its lines ranked that way, so it is
never in one task. What is decided per order is written once; whole lines are
shuffled only if a bitmap of hashed IDs says that their order may need a ranking.

Defined cases: quantities count in thousandths; a null, negative or NaN one
weighs nothing, one beyond 10^12 as much as that; an amount that is no finite
number of units fails the job; an order whose lines
all weigh nothing is shared equally; a negative total is shared like its
amount, with its sign; lines of orders without entries (or without an ID) get
null; null amounts count as nothing; entries of orders without lines are in
``settled_by`` as rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sellerlens import names as N
from sellerlens.plans.joins import maybe_among
from sellerlens.plans.numbering import places
from sellerlens.session import scratch_path

UNITS = 100                   # smallest units of an amount of one
WEIGHT_UNITS = 1000           # steps in which quantities weigh
MOST_WEIGHT = 1e12
MANY_CLASSES = 10_000         # weights of an order that is ranked line by line
SHARE = "Settled share"
SETTLED = "Settled total"
HAS_LINES = "Has lines"


def _exact(x: Column, digits: int) -> Column:
    return x.cast(f"decimal({digits},0)")


def _settled(income: DataFrame, amount: str) -> DataFrame:
    """Per order ``total`` in smallest units: every entry is rounded once."""
    return (income.where(N.c(N.RELATED_ORDER_ID).isNotNull())
                  .groupBy(N.c(N.RELATED_ORDER_ID).cast("string").alias("_sid"))
                  .agg(F.coalesce(F.sum(F.round(N.c(amount) * UNITS).cast("long")), F.lit(0)).alias("_total")))


def _parts(weight: Column) -> tuple[Column, Column]:
    """Whole units and remainder of a line's share, both never negative. Both fit
    a long; only products beyond 2^53 need decimals on the way."""
    weight, total = weight.cast("long"), F.abs("_total")
    small = total.cast("double") * weight.cast("double") < float(1 << 53)
    whole = _exact(F.col("_whole"), 38)
    large = _exact(total, 20) * _exact(weight, 18)
    rest = F.when(small, (total * weight) % F.col("_whole")).otherwise((large % whole).cast("long"))
    units = (F.when(small, ((total * weight - (total * weight) % F.col("_whole")) / F.col("_whole")).cast("long"))
              .otherwise(((large - large % whole) / whole).cast("long")))
    return units, rest


def _orders(lines: DataFrame, income: DataFrame, amount: str, many: int) -> DataFrame:
    """Per order with entries: total, weight of all lines, whether they are
    equal, the units left over, and the boundary class: its remainder ``_cut``,
    its lines ``_ties`` and the units ``_take`` left for them (null for orders of
    more than ``many`` weights). Lines are first combined by weight."""
    classes = lines.where("_oid IS NOT NULL").groupBy("_oid", "_w").agg(F.count(F.lit(1)).alias("_c"))
    whole = classes.groupBy("_oid").agg(F.sum(F.col("_w") * F.col("_c")).alias("_sum"), F.sum("_c").alias("_n"),
                                        (F.count(F.lit(1)) > many).alias("_many"))
    settled = _settled(income, amount)
    per = (whole.join(settled, F.col("_oid") == F.col("_sid"))
                .select("_oid", "_total", (F.col("_sum") == 0).alias("_equal"), "_many",
                        F.when(F.col("_sum") == 0, F.col("_n")).otherwise(F.col("_sum")).alias("_whole")))
    given = classes.join(per, "_oid")
    units, rest = _parts(F.when(F.col("_equal"), 1).otherwise(F.col("_w")))
    order = ["_oid", "_total", "_whole", "_equal", "_many"]
    given = (given.select(*order, units.alias("_units"), rest.alias("_rest"), "_c").groupBy(*order, "_rest")
                  .agg(F.sum(F.col("_units") * F.col("_c")).alias("_given"), F.sum("_c").alias("_ties")))
    left = F.abs(F.first("_total")) - F.sum("_given")
    hot = given.where("_many").groupBy(*order).agg(left.alias("_left"))
    mine = Window.partitionBy("_oid")
    ranked = (given.where("NOT _many")
                   .withColumn("_left", F.abs("_total") - F.sum("_given").over(mine))
                   .withColumn("_before", F.sum("_ties").over(mine.orderBy(F.desc("_rest"))) - F.col("_ties")))
    at = (F.col("_before") < F.col("_left")) & (F.col("_left") <= F.col("_before") + F.col("_ties"))
    ranked = ranked.groupBy(*order, "_left").agg(
        F.max(F.when(at, F.col("_rest"))).alias("_cut"), F.max(F.when(at, F.col("_left") - F.col("_before"))).alias("_take"),
        F.max(F.when(at, F.col("_ties"))).alias("_ties"))
    return ranked.unionByName(hot, allowMissingColumns=True)


def share_out(orders: DataFrame, income: DataFrame, amount: str = N.SETTLEMENT, many: int = MANY_CLASSES) -> DataFrame:
    """The order lines with ``Settled share``: their part of ``amount`` of
    their order's entries, as a long of smallest units."""
    spark = orders.sparkSession
    columns = [N.c(x) for x in orders.columns]
    quantity = F.coalesce(N.c(N.QUANTITY).cast("double"), F.lit(0.0))
    weight = F.when(F.isnan(quantity), 0.0).otherwise(F.least(F.greatest(quantity, F.lit(0.0)), F.lit(MOST_WEIGHT)))
    weight = F.round(weight * WEIGHT_UNITS).cast("long")
    lines = orders.select("*", N.c(N.ORDER_ID).cast("string").alias("_oid"), weight.alias("_w"))
    path = scratch_path(spark, "apportion")
    _orders(lines, income, amount, many).write.parquet(path)
    per = spark.read.parquet(path).withColumnRenamed("_oid", "_id")
    units, rest = _parts(F.when(F.col("_equal"), 1).otherwise(F.col("_w")))

    def with_parts(some: DataFrame) -> DataFrame:
        t = some.join(per, F.col("_oid") == F.col("_id"), "left")
        return t.select(*columns, "_oid", "_left", "_many", "_cut", "_take", "_ties", units.alias("_units"), rest.alias("_rest"),
                        F.when(F.col("_total") < 0, -1).otherwise(1).alias("_sign"))

    # A line without a remainder never gets one of the units left: they are
    # fewer than the lines with one.
    in_part = F.col("_many") | (F.col("_take") < F.col("_ties"))
    competes = ((F.col("_left") > 0) & (F.col("_rest") > 0)
                & (F.col("_many") | ((F.col("_rest") == F.col("_cut")) & (F.col("_take") < F.col("_ties")))))
    told_apart = maybe_among(lines, "_oid", per.where((F.col("_left") > 0) & in_part).select("_id"))
    # Written, as the ranges of the sort are sampled in a pass of their own.
    path = scratch_path(spark, "apportion")
    with_parts(told_apart).where(competes).write.parquet(path)
    ranked = places(spark.read.parquet(path), "_oid",
                    [F.desc("_rest"), *[F.asc_nulls_first(N.c(x)) for x in orders.columns]], "_place")
    more = F.col("_place") < F.when(F.col("_many"), F.col("_left")).otherwise(F.col("_take"))
    ranked = ranked.withColumn("_units", F.col("_units") + F.when(more, 1).otherwise(0))
    rest = with_parts(lines).where(~F.coalesce(competes, F.lit(False)))
    rest = rest.withColumn("_units", F.col("_units") + F.when(F.col("_rest") >= F.col("_cut"), 1).otherwise(0))
    share = (F.col("_units") * F.col("_sign")).cast("long").alias(SHARE)
    return rest.select(*columns, share).unionByName(ranked.select(*columns, share))


def settled_by(orders: DataFrame, income: DataFrame, key: str, amount: str = N.SETTLEMENT) -> DataFrame:
    """``amount`` per value of the order column ``key``; entries of no line (no
    such order, or no ID) are the row with ``Has lines`` = false. The totals
    add up to that of all entries."""
    units = (share_out(orders, income, amount).where(N.c(SHARE).isNotNull())
             .groupBy(N.c(key).alias(key)).agg(F.sum(N.c(SHARE)).alias(SETTLED)).withColumn(HAS_LINES, F.lit(True)))
    known = orders.where(N.c(N.ORDER_ID).isNotNull()).select(N.c(N.ORDER_ID).cast("string").alias("_oid")).distinct()
    alone = income.join(known, N.c(N.RELATED_ORDER_ID).cast("string") == F.col("_oid"), "left_anti")
    alone = (alone.agg(F.coalesce(F.sum(F.round(N.c(amount) * UNITS).cast("long")), F.lit(0)).alias(SETTLED))
             .select(F.lit(None).cast(orders.schema[key].dataType).alias(key), N.c(SETTLED), F.lit(False).alias(HAS_LINES)))
    out = units.unionByName(alone)
    return (out.select(N.c(key), (N.c(SETTLED) / F.lit(float(UNITS))).alias(SETTLED), N.c(HAS_LINES))
               .orderBy(F.desc(N.c(HAS_LINES)), F.desc(N.c(SETTLED)), F.asc_nulls_last(N.c(key))))
