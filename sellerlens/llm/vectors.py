"""Integer vectors and exact sums, shared by the vector operators.

Components become Python-exact integers: rows whose integers are small go as
int64 matrices, the rare others as matrices of Python ints. Sums leave the
tasks in base 2^32, one long a limb, so that Spark adds them without overflow
at any number of rows; the driver gets a fixed number of totals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SAFE = 1 << 52            # integers below are exact as double
WORD = 32                 # bits of a limb of a sum
LONGEST = (1 << 63) - 1
SUMS = "k long, limb int, v long"


def usable(table: DataFrame, column: str = "embedding", extra: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, ``v`` (array of double) and the ``extra`` columns of the rows
    whose vector is there, with every component finite, and of the most common
    length (ties: the shorter one). Vectors without components leave."""
    v = F.col(f"`{column}`").cast("array<double>")
    t = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), *[F.col(f"`{c}`") for c in extra])
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))   # NaN is above infinity
    t = t.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    sizes = t.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("c"))
    most = sizes.orderBy(F.desc("c"), "width").limit(1).collect()
    width = most[0]["width"] if most else 0
    return t.where(F.size("v") == width)


def matrix(batch: pa.RecordBatch, column: str = "v") -> np.ndarray:
    """The vectors of a batch as rows of doubles."""
    n = batch.num_rows
    flat = batch.column(batch.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def floors(x: np.ndarray, factor: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, floor(factor * x)) of the rows of small integers (int64)
    and of those of large ones (Python ints), if there are any."""
    with np.errstate(over="ignore"):
        y = np.floor(x * factor)
    small = (np.abs(y) < SAFE).all(1)
    if small.any():
        yield np.flatnonzero(small), y[small].astype(np.int64)
    if not small.all():
        rows = np.flatnonzero(~small)
        out = np.empty((len(rows), x.shape[1]), object)
        for i, r in enumerate(rows):
            out[i] = [math.floor(Fraction(float(a)) * factor) for a in x[r]]
        yield rows, out


def limbs(keys: np.ndarray, values) -> Iterator[pa.RecordBatch]:
    """Rows (k, limb, v) of sums given as int64 or Python ints."""
    if isinstance(values, np.ndarray) and values.dtype == np.int64:
        some = values != 0
        k, x = np.asarray(keys)[some], values[some]
        parts = [(k, 0, x & ((1 << WORD) - 1)), (k, 1, x >> WORD)]
        k = np.concatenate([p[0] for p in parts])
        limb = np.concatenate([np.full(len(p[0]), p[1], np.int32) for p in parts])
        v = np.concatenate([p[2] for p in parts])
    else:
        rows = []
        for key, value in zip(keys, values):
            value, at = int(value), 0
            while value not in (0, -1):
                rows.append((int(key), at, value & ((1 << WORD) - 1)))
                value >>= WORD
                at += 1
            if value:
                rows.append((int(key), at, value))
        k, limb, v = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    if len(k):
        yield pa.RecordBatch.from_arrays(
            [pa.array(k, pa.int64()), pa.array(limb, pa.int32()), pa.array(v, pa.int64())], ["k", "limb", "v"])


def totals(parts: DataFrame) -> dict[int, int]:
    """Sums by key of rows (k, limb, v). The number of keys must be fixed."""
    out: dict[int, int] = {}
    for r in parts.groupBy("k", "limb").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = out.get(r["k"], 0) + (r["v"] << (WORD * r["limb"]))
    return out


def as_long(values) -> pa.Array:
    """Sums as longs; one that no long holds is null."""
    return pa.array([int(v) if v <= LONGEST else None for v in values], pa.int64())
