"""Cutting lineage through tables in the shared folder."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

from sellerlens.session import scratch_path


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(df: DataFrame) -> DataFrame:
    """Let the Python workers import this package from where the driver has
    it (the same path, as in local mode or on a shared file system; elsewhere
    the package is passed with ``--py-files``). Returns ``df``."""
    env = df.sparkSession.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in (*paths, ROOT) if p)
    return df


def cut(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Later steps start from files every executor can reach, so a lost executor
    costs only its running tasks. The shuffles of the write go with its end,
    not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{kind}")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and no later step reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free(columns: list[str], *wanted: str) -> list[str]:
    """``wanted`` names, each with as many ``_`` added as it takes to be none
    of ``columns`` (whatever their case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Size up to which a join side is broadcast: rows, and bytes of their values.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20


def _bytes(field) -> Column:
    """Bytes of a column's value, strings and arrays as long as they are."""
    c, t = F.col(f"`{field.name}`"), field.dataType
    if isinstance(t, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    if isinstance(t, ArrayType):
        return 8 * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return F.lit(8).cast("long")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Has ``df`` at most ``rows`` rows and BROADCAST_BYTES bytes? ``df``
    should be a written table: it is counted."""
    size = sum((_bytes(f) for f in df.schema), F.lit(0).cast("long"))
    n, held = df.agg(F.count("*"), F.sum(size)).first()
    return n <= rows and (held or 0) <= BROADCAST_BYTES


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is small, else as it is (a shuffled
    join)."""
    return F.broadcast(df) if is_small(df, rows) else df


# A key with more than one row in so many is hot.
HOT_SHARE = 1000


def add_unique(big: DataFrame, side: DataFrame, key: str, count: str) -> DataFrame:
    """``big`` with the columns of ``side`` (one row a key, written, with the
    number of rows of ``big`` in column ``count``) added by ``key``; null keys
    match. Hot keys are ``HOT_SHARE`` at most and are broadcast; the others are
    joined by a shuffle, unless all of ``side`` is small."""
    side = side.withColumnRenamed(key, "__side_key")
    same = F.col(key).eqNullSafe(F.col("__side_key"))
    if is_small(side):
        return big.join(F.broadcast(side), same, "left").drop("__side_key")
    least = (side.agg(F.sum(count)).first()[0] or 0) / HOT_SHARE
    hot = F.broadcast(side.where(F.col(count) > least))
    rest = big.join(hot.select("__side_key"), same, "left_anti").join(side.where(F.col(count) <= least), same, "left")
    return big.join(hot, same, "inner").unionByName(rest).drop("__side_key")
