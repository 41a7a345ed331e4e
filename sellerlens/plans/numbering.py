"""Row numbers over a whole table, from one range-partitioned sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sellerlens.session import scratch_path


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` (written, read back) with ``name``: the number of each row from 0,
    without gaps, under ``order``. Equal rows get any of their numbers.

    Rows are sorted over range partitions and written with their place in
    them, so a lost task cannot change a number; the partitions' sizes, one
    row each, then give what comes before every partition."""
    spark = df.sparkSession
    path = scratch_path(spark, "numbered")
    row = F.monotonically_increasing_id()
    by = [*order, F.col("_tie")]
    (df.withColumn("_tie", row).repartitionByRange(*by).sortWithinPartitions(*by)
       .withColumn("_row", row).drop("_tie").write.parquet(path))
    t = spark.read.parquet(path).withColumn("_part", F.shiftright("_row", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = t.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    starts = starts.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    t = t.join(F.broadcast(starts), "_part")
    return t.withColumn(name, F.col("_start") + F.col("_row").bitwiseAND((1 << 33) - 1)).drop("_part", "_start", "_row")


def places(df: DataFrame, group: str, order: list[Column], place: str) -> DataFrame:
    """``df`` with the place (from 0) of each row within its ``group`` under
    ``order``, without a group ever being in one task: a place is the row's
    number less the least one of its group."""
    t = numbered(df, [F.col(group), *order], "_at")
    first = t.groupBy(group).agg(F.min("_at").alias("_first"))
    return t.join(first, group).withColumn(place, F.col("_at") - F.col("_first")).drop("_at", "_first")
