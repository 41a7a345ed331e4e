"""One large JSON array read by many tasks (SRC-2).

The reader splits a file at ``}``, which Spark's text source does at any byte
range, so every range becomes a task of whole segments. Where a range begins
inside a text, a nested object or an element is not known there, so it is
found out in two passes:

1. every range is scanned for both possible beginnings (outside or inside a
   JSON string) and reports whether it changes that state and by how much the
   nesting changes in either case: three numbers a range;
2. running sums of these in file order (the composition of the ranges' state
   changes) give the true state at the start of each range, and the tasks cut
   out whole elements. An element that crosses ranges is put together from its
   pieces, of which a range has two at most.

No escape crosses a segment, as JSON has no escaped brace. Elements are then
parsed by ``from_json``. Memory is bounded by the longest element, not by the
file. Nothing runs before the result does but a look at the files' sizes; the
text is then scanned three times (states, elements, pieces of elements).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT_BYTES = 64 << 20
BROADCAST_SPLITS = 200_000     # ranges whose states (three numbers and the file's name) are broadcast

_ESCAPE = re.compile(r"\\.", re.S)
_BEFORE = re.compile(r"[\s,]*")
_FIRST = re.compile(r"﻿?\s*\[\s*")


class Scan:
    """State of a JSON text, fed with segments that end before a ``}``."""

    def __init__(self, inside: bool, depth: int):
        self.inside, self.depth = inside, depth

    def feed(self, segment: str) -> bool:
        """Go over a segment and its brace; False if the array ends in it."""
        if "\\" in segment:
            segment = _ESCAPE.sub("", segment)
        parts = segment.split('"')
        for p in parts[self.inside::2]:
            if p:
                self.depth += p.count("{") + p.count("[") - p.count("]")
        self.inside ^= not len(parts) & 1
        if not self.inside:
            if not self.depth:
                return False
            self.depth -= 1
        return True


def _segments(batches) -> Iterator[tuple[tuple[str, int], list, list[str]]]:
    """(file, range), further columns and segments of consecutive rows."""
    for b in batches:
        if not b.num_rows:
            continue
        files, ranges, values = (b.column(i).to_pylist() for i in range(3))
        rest = [b.column(i) for i in range(3, b.num_columns)]
        start = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or files[i] != files[start] or ranges[i] != ranges[start]:
                yield (files[start], ranges[start]), [c[start].as_py() for c in rest], values[start:i]
                start = i


def _effects(batches):
    """How each range changes the state, for either beginning."""
    key, two = None, None

    def told():
        out, inn = two
        return pa.RecordBatch.from_pylist([{"file": key[0], "range": key[1], "flips": int(out.inside),
                                            "out": out.depth - _HIGH, "inn": inn.depth - _HIGH}], schema=_EFFECT)

    for k, _, values in _segments(batches):
        if k != key:
            if key is not None:
                yield told()
            key, two = k, (Scan(False, _HIGH), Scan(True, _HIGH))
        for v in values:
            for s in two:
                s.feed(v)
    if key is not None:
        yield told()


_HIGH = 1 << 40            # a depth that no range comes down from
_EFFECT = pa.schema([("file", pa.string()), ("range", pa.int64()), ("flips", pa.int32()),
                     ("out", pa.int64()), ("inn", pa.int64())])
_PIECE = pa.schema([("file", pa.string()), ("range", pa.int64()), ("kind", pa.string()), ("json", pa.string())])


def _element(text: str, first: bool) -> str:
    """A whole element's text, without what separates it from the last one."""
    start = (_FIRST if first else _BEFORE).match(text)
    if start is None or not text.startswith("{", start.end()):
        raise ValueError(f"not a JSON array of objects: {text[:80]!r}")
    return text[start.end():]


def _pieces(batches):
    """Elements of a range ("whole"), and what a range has of elements that
    cross its ends: "head" (an element ends in it), "tail" (one begins in it),
    "part" (one goes through it); "end" is what follows the last element."""
    key = scan = None
    held: list[str] = []
    begun = True               # does an element begin in this range?

    def row(kind, text):
        return {"file": key[0], "range": key[1], "kind": kind, "json": text}

    def left(out):
        if key is not None and held:
            text = "".join(held)
            out.append(row("tail" if begun else "part", text))

    for k, state, values in _segments(batches):
        out: list[dict] = []
        if k != key:
            left(out)
            key, held = k, []
            if state[0] is None:
                raise RuntimeError(f"{k[0]} was split in another way in the first pass")
            if not state[2]:
                raise ValueError(f"not a JSON array, or not a whole one: {k[0]}")
            scan = Scan(bool(state[0]), state[1])
            begun = k[1] == 0 or (not scan.inside and scan.depth == 1)
            first = k[1] == 0
        for v in values:
            if not scan.feed(v):
                held.append(v)
                out.append(row("end", "".join(held)))
                held, begun = [], True
                continue
            held.append(v + "}")
            if scan.depth == 1 and not scan.inside:
                text = "".join(held)
                out.append(row("whole", _element(text, first)) if begun else row("head", text))
                held, begun, first = [], True, False
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_PIECE)
    out = []
    left(out)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_PIECE)


def _states(effects: DataFrame) -> DataFrame:
    """inside, depth at the start of each range (running compositions), and
    whether the file's array is closed."""
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    t = effects.withColumn("inside", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
    t = t.withColumn("change", F.when(F.col("inside") == 0, F.col("out")).otherwise(F.col("inn")))
    # The end of an array counts like a brace: one level below the file's start.
    whole = Window.partitionBy("file")
    closed = (F.sum("flips").over(whole) % 2 == 0) & (F.sum("change").over(whole) == -1)
    return t.select("file", "range", F.col("inside").cast("int").alias("inside"),
                    F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"), closed.alias("closed"))


def element_texts(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES,
                  broadcast_splits: int = BROADCAST_SPLITS) -> DataFrame:
    """Column ``json``: the text of every element of the array in each file of
    ``path``. Raises (in the tasks) where a file is no array of objects."""
    # A session of its own, so that both passes split the files in the same way.
    s = spark.newSession()
    s.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    s.conf.set("spark.sql.files.openCostInBytes", str(min(split_bytes, 4 << 20)))
    s.conf.set("spark.sql.files.minPartitionNum", "1")
    rows = s.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), "value")
    states = _states(rows.mapInArrow(_effects, "file string, range long, flips int, out long, inn long"))
    size = s.read.format("binaryFile").load(path).agg(F.sum(F.ceil(F.col("length") / split_bytes) + 1)).first()[0] or 0
    if size <= broadcast_splits:
        at = rows.join(F.broadcast(states), ["file", "range"], "left")
    else:
        rows = rows.withColumn("row", F.monotonically_increasing_id())
        at = rows.join(states, ["file", "range"], "left").sortWithinPartitions("file", "range", "row")
    found = at.select("file", "range", "value", "inside", "depth", "closed").mapInArrow(
        _pieces, "file string, range long, kind string, json string")
    whole = found.where("kind = 'whole'").select("json")
    begins = F.when(F.col("kind").isin("tail", "end"), 1).otherwise(0)
    order = Window.partitionBy("file").orderBy("range", begins).rowsBetween(Window.unboundedPreceding, 0)
    crossing = found.where("kind <> 'whole'").withColumn("nr", F.sum(begins).over(order))
    parts = F.sort_array(F.collect_list(F.struct("range", "json")))
    joined = (crossing.groupBy("file", "nr").agg(parts.alias("p"), F.max(F.col("kind") == "end").alias("ended"))
              .select(F.array_join("p.json", "").alias("text"), "ended"))
    start = F.regexp_replace("text", "^﻿?[\\s,]*(\\[\\s*)?", "")
    ok = F.when(F.col("ended"), F.col("text").rlike("^﻿?\\s*(\\[\\s*)?\\]\\s*$")).otherwise(
        start.startswith("{") & start.endswith("}"))
    checked = joined.select(F.when(ok, F.when(~F.col("ended"), start)).otherwise(
        F.raise_error(F.concat(F.lit("not a JSON array of objects: "), F.substring("text", 1, 80)))).alias("json"))
    return whole.unionByName(checked.where(F.col("json").isNotNull()))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str,
                    split_bytes: int = SPLIT_BYTES, **options) -> DataFrame | None:
    """SRC-2: the objects of the JSON array in each file as rows, read by many
    tasks a file; ``None`` when the path does not exist.

    ``options`` are those of ``from_json`` (by default a field that does not
    fit is null). An empty array has no rows; row order is not kept.
    """
    try:
        texts = element_texts(spark, path, split_bytes)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            return None
        raise
    return texts.select(F.from_json("json", schema, options).alias("r")).select("r.*")
