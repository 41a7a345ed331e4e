"""Incremental cleaning of order exports as new files arrive.

The order cleaning is row-wise (no shuffle, no state), so the batch
function applies unchanged to a streaming DataFrame. Each trigger reads
only the files not yet seen, cleans them and appends them to a Parquet
table partitioned by ``Order_Month``; the checkpoint in the shared folder
makes the output exactly-once across restarts and lost executors.

Settlement classification is not streamed: a later entry can change the
label of an earlier one (group sizes), so it needs the whole table and
runs as a batch job over the accumulated entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sellerlens import names as N
from sellerlens.operators.cleaning import clean_orders
from sellerlens.sources.files import ORDERS_TYPES, conform

def stream_clean_orders(spark: SparkSession, source_dir: str, schema: T.StructType | None = None,
                        fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of cleaned order lines from files in ``source_dir``.

    Without a ``schema`` the files already there give it (a quantity keeps
    its type); pass one to start on an empty folder."""
    if schema is None:
        schema = spark.read.format(fmt).load(source_dir).schema
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return clean_orders(conform(reader.load(source_dir), ORDERS_TYPES))


def start_clean_orders(spark: SparkSession, source_dir: str, target_dir: str,
                       checkpoint_dir: str, available_now: bool = True,
                       interval: str = "1 minute") -> StreamingQuery:
    """Start the incremental cleaning; ``available_now`` processes what is
    there and stops, otherwise it runs every ``interval``.

    ``checkpoint_dir`` (on shared storage) belongs to the target: every start
    must be given the same one, or new files would be taken for batches the
    target already has.
    """
    writer = (stream_clean_orders(spark, source_dir).writeStream
              .format("parquet")
              .option("checkpointLocation", checkpoint_dir)
              .partitionBy(N.ORDER_MONTH)
              .outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start(target_dir)
