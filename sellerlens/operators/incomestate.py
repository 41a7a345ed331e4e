"""Settlement labels kept up to date under new entries (IN-2 … IN-10).

A late entry changes the labels of earlier entries of its related order. The
store keeps, beside the labelled entries, the statistics that decide labels:
one row per (related ID, adjustment ID) with its number of entries and its
adjustment flag. Both add up (sum, or), so a batch's own statistics are merged
into the stored ones, and no old entry is read to find out what changed.

Everything is dealt into ``buckets`` by the related ID, on which alone labels
depend. A batch then

* reads and replaces the statistics of the buckets that its IDs fall into,
* appends its entries, labelled, where no label of an old entry changes (a
  third, fourth … entry of an ID mostly changes nothing, so a hot ID is not
  rewritten again and again),
* rewrites the entries of a bucket where one does, or where ``MAX_PARTS``
  appended parts have come together.

Other buckets are neither read nor written. The result after any sequence of
batches equals ``classify_income`` of all entries together. A hot ID makes its
bucket large, not a task: statistics are combined before their shuffle, the
labels are joined from one row per ID pair, and Spark reads a bucket's files
in as many tasks as their size asks for.

    base/data/<id>/{entries,state}/sl_bucket=<n>     written once, never changed
    base/commits/<number>                            the parts of every bucket

A batch becomes visible by its commit record, written last; what a dead writer
left is not in any record. A batch name that was committed before is not
added again, so a job (or a stream's ``foreachBatch``) may simply be repeated.

Defined cases: null IDs are one group, as in ``classify_income``; an empty
batch only leaves its record; all batches have the columns and types of the
first one; floating-point IDs are refused.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sellerlens import names as N
from sellerlens.functions.text import with_settled_date
from sellerlens.operators.income import _id_stats, _labels, _norm, _pair_stats, abs_fees, ids_as_text
from sellerlens.sinks.snapshots import CommitConflict
from sellerlens.sources.files import strip_headers

BUCKET = "sl_bucket"
MAX_PARTS = 16
KEYS = ["_rk", "_rn", "_ak", "_an"]
STATE = "_rk string, _rn boolean, _ak string, _an boolean, n_pair bigint, _comp_pair boolean"
RECORD = "kind string, bucket int, part string"


@dataclass(frozen=True)
class Store:
    """A committed state: ``entries`` and ``state`` name the parts of every
    bucket (at most ``MAX_PARTS`` and one), ``batches`` what has been added."""
    number: int
    buckets: int
    entries: dict[int, tuple[str, ...]]
    state: dict[int, str]
    batches: frozenset[str]


@dataclass(frozen=True)
class Merge:
    """What a batch did: buckets whose statistics it merged, and whose old
    entries it read and rewrote."""
    touched: frozenset[int]
    rewritten: frozenset[int]


def _numbers(spark: SparkSession, base: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base}/commits")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName()) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_store(spark: SparkSession, base: str, number: int | None = None) -> Store | None:
    """The last committed state, or that of commit ``number``; None before
    the first batch."""
    base = base.rstrip("/")
    done = _numbers(spark, base)
    if not done:
        return None
    number = done[-1] if number is None else number
    rows = spark.read.schema(RECORD).parquet(f"{base}/commits/{number}").collect()
    parts: dict[int, list[str]] = {}
    for r in rows:
        if r.kind == "entries":
            parts.setdefault(r.bucket, []).append(r.part)
    return Store(number, next(r.bucket for r in rows if r.kind == "buckets"),
                 {b: tuple(sorted(p)) for b, p in parts.items()},
                 {r.bucket: r.part for r in rows if r.kind == "state"},
                 frozenset(r.part for r in rows if r.kind == "batch"))


def _read(spark: SparkSession, base: str, kind: str, parts: list[tuple[int, str]], schema) -> DataFrame:
    """The given parts (bucket, id) with their bucket, and no others."""
    if not parts:
        return spark.createDataFrame([], schema).withColumn(BUCKET, F.lit(0))
    frames = {}
    for b, part in parts:
        frames.setdefault(part, []).append(f"{base}/data/{part}/{kind}/{BUCKET}={b}")
    out = None
    for part, paths in sorted(frames.items()):
        one = spark.read.schema(schema).option("basePath", f"{base}/data/{part}/{kind}").parquet(*paths)
        out = one if out is None else out.unionByName(one)
    return out


def _bucket(buckets: int):
    key, null = _norm(N.c(N.RELATED_ORDER_ID))
    return F.pmod(F.xxhash64(key, null), F.lit(buckets)).cast("int")


def _label(entries: DataFrame, state: DataFrame) -> DataFrame:
    """``entries`` with the three labels that ``state`` (which covers them) gives."""
    rk, rn = _norm(N.c(N.RELATED_ORDER_ID))
    ak, an = _norm(N.c(N.ADJUSTMENT_ID))
    ids = _id_stats(state)
    j = (entries.join(ids, (rk == ids["_irk"]) & (rn == ids["_irn"]), "left")
                .join(state.select(*KEYS, "n_pair"), (rk == F.col("_rk")) & (rn == F.col("_rn"))
                      & (ak == F.col("_ak")) & (an == F.col("_an")), "left"))
    labels = _labels(F.col("n_rid"), F.col("n_pair"), F.col("comp"))
    return j.select(*[N.c(x) for x in entries.columns if x != BUCKET],
                    *[e.alias(n) for n, e in labels.items()], BUCKET)


def _write(df: DataFrame, path: str) -> None:
    """One folder a bucket; AQE splits a hot bucket over several files."""
    df.hint("rebalance", BUCKET).write.mode("error").partitionBy(BUCKET).parquet(path)


def _changed_buckets(old: DataFrame, new: DataFrame, delta: DataFrame) -> set[int]:
    """Buckets in which a label of an entry that was there changes."""
    pairs = (old.select(*KEYS, BUCKET, "n_pair").join(delta.select(*KEYS), KEYS, "left_semi")
                .where("n_pair = 1").select(BUCKET))
    was = old.groupBy(BUCKET, "_rk", "_rn").agg(F.sum("n_pair").alias("n"), F.bool_or("_comp_pair").alias("comp"))
    now = new.groupBy(BUCKET, "_rk", "_rn").agg(F.sum("n_pair").alias("m"), F.bool_or("_comp_pair").alias("comp_now"))
    ids = was.join(now, [BUCKET, "_rk", "_rn"]).where("(n = 1 AND m > 1) OR comp <> comp_now").select(BUCKET)
    return {r[0] for r in pairs.unionByName(ids).distinct().collect()}      # bucket numbers: bounded


def add_batch(spark: SparkSession, base: str, batch: DataFrame, name: str, buckets: int = 256) -> Merge:
    """Add the entries of ``batch`` under the name ``name`` and commit.

    ``buckets`` counts for the first batch only. Raises ``CommitConflict``
    (and changes nothing) if another writer has committed since this began."""
    base = base.rstrip("/")
    store = read_store(spark, base) or Store(0, buckets, {}, {}, frozenset())
    if name in store.batches:
        return Merge(frozenset(), frozenset())
    here = uuid.uuid4().hex
    data = f"{base}/data/{here}"

    plain = abs_fees(ids_as_text(strip_headers(batch)))
    plain = with_settled_date(plain, N.SETTLED_TIME, N.SETTLED_TIME).withColumn(BUCKET, _bucket(store.buckets))
    # Written once (it is used three times); read back with its bucket.
    plain.write.partitionBy(BUCKET).parquet(f"{data}/fresh")
    schema = plain.schema
    fresh = spark.read.schema(schema).parquet(f"{data}/fresh")

    delta = _pair_stats(fresh).withColumn(BUCKET, _state_bucket(store.buckets))
    touched = frozenset(r[0] for r in fresh.select(BUCKET).distinct().collect())
    if not touched:
        _commit(spark, base, store, name, {}, {}, here)
        return Merge(touched, frozenset())
    wanted = f"{STATE}, {BUCKET} int"
    old = _read(spark, base, "state", [(b, store.state[b]) for b in touched if b in store.state], STATE)
    old = old.select(*KEYS, "n_pair", "_comp_pair", F.col(BUCKET).cast("int").alias(BUCKET))
    merged = (old.unionByName(delta).groupBy(*KEYS, BUCKET)
                 .agg(F.sum("n_pair").alias("n_pair"), F.bool_or("_comp_pair").alias("_comp_pair")))
    _write(merged, f"{data}/state")
    new = spark.read.schema(wanted).parquet(f"{data}/state")

    rewritten = {b for b in touched if len(store.entries.get(b, ())) >= MAX_PARTS}
    if store.state:
        rewritten |= _changed_buckets(old, new, delta)
    again = [(b, p) for b in sorted(rewritten) for p in store.entries.get(b, ())]
    entries = fresh
    if again:
        columns = [f for f in schema if f.name != BUCKET]
        stored = _read(spark, base, "entries", again, type(schema)(columns))
        entries = stored.select(*[N.c(x) for x in fresh.columns]).unionByName(fresh)
    _write(_label(entries, new), f"{data}/entries")

    after = {b: (() if b in rewritten else store.entries.get(b, ())) + (here,) for b in touched}
    _commit(spark, base, store, name, after, dict.fromkeys(touched, here), here)
    return Merge(touched, frozenset(rewritten))


def _state_bucket(buckets: int):
    return F.pmod(F.xxhash64("_rk", "_rn"), F.lit(buckets)).cast("int")


def _commit(spark: SparkSession, base: str, store: Store, name: str, entries: dict, state: dict, here: str) -> None:
    parts = {**store.entries, **entries}
    rows = [("entries", b, p) for b, ps in parts.items() for p in ps]
    rows += [("state", b, p) for b, p in {**store.state, **state}.items()]
    rows += [("batch", 0, n) for n in (*store.batches, name)] + [("buckets", store.buckets, here)]
    try:
        (spark.createDataFrame(rows, RECORD).coalesce(1)
              .write.mode("error").parquet(f"{base}/commits/{store.number + 1}"))
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" in (e.getCondition() or ""):
            raise CommitConflict(f"commit {store.number + 1} exists") from e
        raise


def read_entries(spark: SparkSession, base: str, number: int | None = None) -> DataFrame | None:
    """The labelled entries of the last commit (or of commit ``number``), with
    the columns of ``classify_income``; None before the first entry."""
    base = base.rstrip("/")
    store = read_store(spark, base, number)
    parts = [(b, p) for b, ps in store.entries.items() for p in ps] if store else []
    if not parts:
        return None
    paths = [f"{base}/data/{p}/entries/{BUCKET}={b}" for b, p in sorted(parts)]
    return spark.read.parquet(*paths)
