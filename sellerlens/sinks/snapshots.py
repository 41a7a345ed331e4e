"""Consistent versions of the three prepared tables (SRC-3, SRC-5).

``write_tables`` replaces three folders one after another; a writer that dies
in between leaves tables of different age. Here every write goes to a folder
of its own, and one small commit record, written last, makes all three tables
visible at once. A reader takes the latest record and keeps to its version,
whatever is committed later. ``drop_old`` is the reset: it removes versions
that are no longer the latest, and what dead writers left.

    base/versions/<id>/{orders,income,overview}
    base/commits/<number>          one line: number and version id

A record becomes visible by the rename with which Spark commits a task's file,
so it is there as a whole or not at all.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sellerlens.sinks.tables import TablePaths, read_tables, write_tables
from sellerlens.sources.files import Tables


class CommitConflict(RuntimeError):
    """Another writer has committed since this one began."""


@dataclass(frozen=True)
class Snapshot:
    """A committed version; ``number`` grows with every commit."""
    number: int
    version: str
    paths: TablePaths


def _paths(base: str, version: str) -> TablePaths:
    v = f"{base}/versions/{version}"
    return TablePaths(f"{v}/orders", f"{v}/income", f"{v}/overview")


def _commits(spark: SparkSession, base: str) -> list[tuple[int, str]]:
    """(number, version) of all commits, oldest first: a record each."""
    try:
        lines = [r[0] for r in spark.read.text(f"{base}/commits/*").collect()]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            return []
        raise
    return sorted((int(n), v) for n, v in (x.split() for x in lines))


def latest(spark: SparkSession, base: str) -> Snapshot | None:
    """The last committed version, None before the first commit."""
    base = base.rstrip("/")
    done = _commits(spark, base)
    return Snapshot(*done[-1], _paths(base, done[-1][1])) if done else None


def write_snapshot(spark: SparkSession, tables: Tables, base: str) -> Snapshot:
    """Write the three tables as a new version and commit it.

    Raises ``CommitConflict`` (and changes nothing) if another writer has
    committed since this one began."""
    base = base.rstrip("/")
    before = latest(spark, base)
    number, version = (before.number if before else 0) + 1, uuid.uuid4().hex
    paths = write_tables(tables, f"{base}/versions/{version}", mode="error")
    record = spark.range(1, numPartitions=1).select(F.lit(f"{number} {version}").alias("value"))
    try:
        record.write.mode("error").text(f"{base}/commits/{number}")
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" in (e.getCondition() or ""):
            raise CommitConflict(f"commit {number} exists") from e
        raise
    return Snapshot(number, version, paths)


def read_snapshot(spark: SparkSession, base: str, number: int | None = None) -> Tables | None:
    """The tables of the last version, or of commit ``number``; None if there
    is none. The result stays with that version."""
    base = base.rstrip("/")
    done = dict(_commits(spark, base))
    version = done.get(max(done, default=None) if number is None else number)
    return read_tables(spark, _paths(base, version)) if version else None


def drop_old(spark: SparkSession, base: str, keep: int = 1) -> list[str]:
    """Delete all versions but the ``keep`` last committed ones, with their
    records; returns their ids. Not while a writer is at work: a version that
    is not committed yet counts as left behind."""
    if keep < 1:
        raise ValueError("the last version stays")
    base = base.rstrip("/")
    done = _commits(spark, base)
    stay = {v for _, v in done[-keep:]}
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    root = path(f"{base}/versions")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    gone = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName() not in stay)
    for n, v in done[:-keep]:                  # first the record: no reader begins on it any more
        fs.delete(path(f"{base}/commits/{n}"), True)
    for v in gone:
        fs.delete(path(f"{base}/versions/{v}"), True)
    return gone
