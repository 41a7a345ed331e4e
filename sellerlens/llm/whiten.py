"""Embedding whitening from exact variances.

Components become integers x. With n vectors and sums S, every centred value
n*x - S is an integer, and the squared centred values of each dimension and of
each sum of two dimensions are added up exactly. Polarisation gives all cross
covariances as differences of these variances: (Var(a+b) - Var(a) - Var(b)) / 2.
The matrix goes to ``eigh``; vectors are projected on its leading components
and divided by the root of their eigenvalues.

Three passes over the vectors: sums, squares, and the covariance of the result
as a check. Tasks send totals only (dimensions squared, whatever the rows).

Defined cases: rows whose vector is null, empty, not finite throughout or not
of the most common length leave (see ``vectors.usable``); a null vec_id and
repeated rows are rows like others; a component without variance beyond
rounding (``FLAT`` of the largest) has null ``whitened``; without any variance
``explained`` and ``identity_error`` are null, too; a deviation beyond a long
is null; an empty table gives no rows; extra columns stay out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sellerlens.llm.vectors import SUMS, as_long, floors, limbs, matrix, totals, usable
from sellerlens.llm.work import ship

FACTOR = 64
SHIFT = 1_000_000
COMPONENTS = 32
FLAT = 1e-12
BLOCK = 1024              # rows whose pair sums are formed together


def _integers(batch, factor, shift):
    for rows, x in floors(matrix(batch), factor):
        yield rows, x + shift


def _centred(batch, factor, shift, n, s):
    """(row numbers, n * x - S), as int64 where that and sums of two fit."""
    wide = np.array(s, object)
    for rows, x in _integers(batch, factor, shift):
        if x.dtype == np.int64 and max(n * int(np.abs(x).max()), max(map(abs, s))) < 1 << 60:
            yield rows, n * x - np.array(s, np.int64)
        else:
            yield rows, n * x.astype(object) - wide


def square_sums(x: np.ndarray) -> list[int]:
    """Exact sums of the squares of each column, in limbs where one product
    of int64 could overflow."""
    if x.dtype != np.int64:
        return [int(v) for v in (x * x).sum(0)]
    x = np.abs(x)
    bits, rows = int(x.max(initial=0)).bit_length(), len(x).bit_length()
    if 2 * bits + rows <= 62:
        return np.einsum("ij,ij->j", x, x).tolist()
    w = (62 - rows) // 2
    parts = [(x >> (w * i)) & ((1 << w) - 1) for i in range(-(-bits // w))]
    out = [0] * x.shape[1]
    for i, a in enumerate(parts):
        for j, b in enumerate(parts[:i + 1]):
            for k, v in enumerate(np.einsum("ij,ij->j", a, b).tolist()):
                out[k] += v << (w * (i + j) + (i != j))
    return out


def fit_sums(vectors: DataFrame, factor: int, shift: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension."""
    def add(batches):
        n, s = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            for _, x in _integers(b, factor, shift):
                n += len(x)
                t = [int(v) for v in x.sum(0)] if len(x) < 1 << 10 or x.dtype != np.int64 else [
                    sum(int(v) for v in c) for c in zip(*(x[k:k + 1024].sum(0) for k in range(0, len(x), 1024)))]
                s = t if s is None else [a + b for a, b in zip(s, t)]
        if n:
            yield from limbs(range(len(s) + 1), [n, *s])

    got = totals(ship(vectors).select("v").mapInArrow(add, SUMS))
    n = got.pop(0, 0)
    width = vectors.select(F.size("v")).first() if n else None
    return n, [got.get(i + 1, 0) for i in range(width[0] if width else 0)]


def covariance(vectors: DataFrame, n: int, s: list[int], factor: int, shift: int) -> np.ndarray:
    """Covariance (divisor n) of the integers, each entry rounded once."""
    d = len(s)
    told = ship(vectors).sparkSession.sparkContext.broadcast((n, s))     # d + 1 numbers

    def add(batches):
        n, s = told.value
        out = [0] * (d * (d + 1) // 2)
        for b in batches:
            if not b.num_rows:
                continue
            for _, y in _centred(b, factor, shift, n, s):
                for k in range(0, len(y), BLOCK):
                    part = y[k:k + BLOCK]
                    at = 0
                    for i in range(d):
                        # dimension i alone, then its sums with the later ones
                        both = np.concatenate([part[:, i:i + 1], part[:, i + 1:] + part[:, i:i + 1]], 1)
                        for v in square_sums(both):
                            out[at] += v
                            at += 1
        yield from limbs(range(len(out)), out)

    got = totals(vectors.select("v").mapInArrow(add, SUMS))
    first = np.cumsum([0, *range(d, 0, -1)])
    own = [got.get(int(first[i]), 0) for i in range(d)]
    out = np.empty((d, d))
    for i in range(d):
        out[i, i] = own[i] / n ** 3
        for j in range(i + 1, d):
            out[i, j] = out[j, i] = (got.get(int(first[i]) + j - i, 0) - own[i] - own[j]) / (2 * n ** 3)
    return out


def components(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit vectors as
    columns (largest entry positive)."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:count], u[:, ::-1][:, :count]
    return e, u * np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])


def whitened(vectors: DataFrame, n: int, s: list[int], project: np.ndarray, factor: int, shift: int) -> DataFrame:
    """vec_id, deviation and ``w``, the whitened components."""
    told = ship(vectors).sparkSession.sparkContext.broadcast((n, s, project))    # d x components numbers

    def f(batches):
        n, s, project = told.value
        for b in batches:
            rows = b.num_rows
            w, deviation = np.empty((rows, project.shape[1])), np.empty(rows, object)
            for at, y in _centred(b, factor, shift, n, s) if rows else ():
                deviation[at] = square_sums(np.ascontiguousarray(y.T))
                mean = y / n if y.dtype == np.int64 else np.array([[v / n for v in r] for r in y.tolist()], float)
                w[at] = mean @ project
            ends = pa.array(np.arange(rows + 1) * project.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), as_long(deviation), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))],
                ["vec_id", "deviation", "w"])

    return vectors.select("vec_id", "v").mapInArrow(f, "vec_id long, deviation long, w array<double>")


def identity_error(result: DataFrame, n: int, count: int) -> float:
    """Largest entry of the result's covariance (divisor n) less the identity."""
    def add(batches):
        total = np.zeros((count + 1, count))
        for b in batches:
            if b.num_rows:
                w = matrix(b, "w")
                total[:count] += w.T @ w
                total[count] += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["k", "v"])

    parts = ship(result).select("w").mapInArrow(add, "k long, v double").groupBy("k").agg(F.sum("v").alias("v"))
    total = np.zeros(count * (count + 1))
    for r in parts.collect():
        total[r["k"]] = r["v"]
    total = total.reshape(count + 1, count) / n
    return float(np.abs(total[:count] - np.outer(total[count], total[count]) - np.eye(count)).max())


RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def whiten(table: DataFrame, factor: int = FACTOR, shift: int = SHIFT, count: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    vectors = usable(table)
    n, s = fit_sums(vectors, factor, shift)
    if not n:
        return table.sparkSession.createDataFrame([], RESULT)
    v = covariance(vectors, n, s, factor, shift)
    e, u = components(v, count)
    whole = float(np.trace(v))
    good = int((e > FLAT * max(e[0], 0.0)).sum()) if whole > 0 else 0
    t = whitened(vectors, n, s, u[:, :good] / np.sqrt(e[:good]), factor, shift)
    off = identity_error(t, n, good) if good else None
    shares = [max(float(x), 0.0) / whole if whole > 0 else None for x in e]
    t = t.select("vec_id", "deviation", "w", F.posexplode(F.array(*[F.lit(x).cast("double") for x in shares])).alias("at", "explained"))
    return t.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                    F.get("w", F.col("at")).alias("whitened"), "explained", F.lit(off).cast("double").alias("identity_error"))
