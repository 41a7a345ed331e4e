"""Vector code compression with exact integer arithmetic.

Vectors become integers and are cut into equal parts; every part position has
a codebook that a few rounds of k-means improve. Distances are exact: integers
are broken into limbs so small that a float64 matrix product of two limbs stays
below 2^53, the products are recombined in int64, and the first smallest
distance wins. Integers too large for int64 distances (components beyond about
a million) are compared as Python ints, so every finite vector is coded.

Every round is one pass over the vectors: tasks add up their parts by entry and
send a fixed number of totals (parts x entries x width), which Spark sums
exactly. Codebooks are broadcast; their size is fixed by the parameters.

Defined cases: rows whose vector is null, empty, not finite throughout or not of
the most common length leave (see ``vectors.usable``); if that length is no
multiple of ``parts``, vectors are filled up with zeros; fewer vectors than
entries give smaller codebooks; a null vec_id comes last among the first ids;
of rows with the same vec_id the smaller vector comes first, and each is coded;
an error beyond a long is null (as is a sum of errors); an empty table gives
no rows; extra columns stay out.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sellerlens.llm.vectors import LONGEST, SUMS, as_long, floors, limbs, matrix, totals, usable
from sellerlens.llm.work import add_unique, cut, ship

FACTOR = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2


def limb_bits(width: int) -> int:
    """Bits of a limb: sums of ``width`` products of two stay below 2^53."""
    return (53 - math.ceil(math.log2(max(width, 1)))) // 2


def exact_products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All dot products of the rows of two int64 matrices, which must fit in
    int64, by float64 matrix products of their limbs."""
    bits = limb_bits(x.shape[1])
    low = (1 << bits) - 1

    def split(m):
        count = -(-(int(np.abs(m).max(initial=0)).bit_length() + 1) // bits)
        return [((m >> (bits * i)) & low if i < count - 1 else m >> (bits * i)).astype(np.float64) for i in range(count)]

    out = np.zeros((len(x), len(c)), np.int64)
    right = split(c)
    for i, a in enumerate(split(x)):
        for j, b in enumerate(right):
            out += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return out


def largest(width: int) -> int:
    """Integers up to this have distances that fit in int64."""
    return math.isqrt(LONGEST // (4 * width))


def nearest_entries(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first nearest entry (rows of ``c``, Python ints) and the
    squared distance, for each row of ``x``."""
    most = largest(x.shape[1])
    near = np.array([max(map(abs, e)) <= most for e in c.tolist()])
    if x.dtype != np.int64 or int(np.abs(x).max(initial=0)) > most:
        near[:] = False
        x = x.astype(object)
    at = best = None
    if near.any():
        ids = np.flatnonzero(near)
        e = c[near].astype(np.int64)
        d = (x * x).sum(1)[:, None] - 2 * exact_products(x, e) + (e * e).sum(1)[None]
        first = d.argmin(1)
        at, best = ids[first], d[np.arange(len(x)), first]
    for j in np.flatnonzero(~near):
        d = ((x.astype(object) - c[j][None]) ** 2).sum(1)
        if at is None:
            at, best = np.full(len(x), j), d
        else:
            better = (d < best) | ((d == best) & (j < at))
            at, best = np.where(better, j, at), np.where(better, d, best.astype(object))
    return at, best


def _assign(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, list]:
    """Codes (rows by parts) and exact errors of integer vectors."""
    size = books[0].shape[1]
    at, error = [], []
    for p, c in enumerate(books):
        a, d = nearest_entries(x[:, p * size:(p + 1) * size], c)
        at.append(a)
        error.append(d)
    if all(d.dtype == np.int64 and int(d.max(initial=0)) <= LONGEST // len(books) for d in error):
        return np.stack(at, 1), np.sum(error, 0, dtype=np.int64).tolist()
    return np.stack(at, 1), [sum(map(int, d)) for d in zip(*error)]


def _filled(x: np.ndarray, parts: int) -> np.ndarray:
    more = -x.shape[1] % parts
    return np.concatenate([x, np.zeros((len(x), more))], 1) if more else x


def first_books(vectors: DataFrame, factor: int, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the first vectors, as matrices of Python ints."""
    ids = [r[0] for r in vectors.select("vec_id").orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()]
    if not ids:
        return []
    if ids[-1] is not None:                 # only the tasks that have those rows send some
        vectors = vectors.where(F.col("vec_id") <= ids[-1])
    rows = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    x = _filled(np.array([r["v"] for r in rows], float), parts)
    whole = np.empty(x.shape, object)
    for at, y in floors(x, factor):
        whole[at] = y.astype(object)
    return np.split(whole, parts, axis=1)


def _round(vectors: DataFrame, books: list[np.ndarray], factor: int) -> list[np.ndarray]:
    """Every entry becomes the floor of its parts' mean."""
    parts, (entries, size) = len(books), books[0].shape
    told = ship(vectors).sparkSession.sparkContext.broadcast(books)   # parts x entries x size numbers

    def add(batches):
        books = told.value
        sums = np.zeros((parts, entries, size + 1), np.int64)         # the last one counts
        for b in batches:
            if not b.num_rows:
                continue
            for _, x in floors(_filled(matrix(b), parts), factor):
                at, _ = _assign(x, books)
                for p in range(parts):
                    part = x[:, p * size:(p + 1) * size]
                    np.add.at(sums[p, :, size], at[:, p], 1)
                    if x.dtype == np.int64 and len(x) * (int(np.abs(part).max()) + 1) < 1 << 62:
                        if int(np.abs(sums[p]).max()) >= 1 << 62:
                            yield from limbs(np.arange(sums.size), sums.ravel())
                            sums[:] = 0
                        np.add.at(sums[p, :, :size], at[:, p], part)
                    else:
                        key = ((p * entries + at[:, p])[:, None] * (size + 1) + np.arange(size)[None]).ravel()
                        yield from limbs(key, part.astype(object).ravel())
        yield from limbs(np.arange(sums.size), sums.ravel())

    got = totals(vectors.select("v").mapInArrow(add, SUMS))
    out = []
    for p, old in enumerate(books):
        new = old.copy()
        for e in range(entries):
            k = (p * entries + e) * (size + 1)
            count = got.get(k + size, 0)
            if count:
                new[e] = [got.get(k + i, 0) // count for i in range(size)]
        out.append(new)
    return out


def fit(vectors: DataFrame, factor: int = FACTOR, parts: int = PARTS, entries: int = ENTRIES,
        rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of every part position (matrices of Python ints), empty if
    there are no vectors. ``vectors`` is a result of ``vectors.usable``."""
    books = first_books(vectors, factor, parts, entries)
    for _ in range(rounds if books else 0):
        books = _round(vectors, books, factor)
    return books


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for c in books for e in c for v in e).encode()).hexdigest()


def assign(vectors: DataFrame, books: list[np.ndarray], factor: int = FACTOR) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every vector."""
    label = vectors.schema["label"]
    parts = len(books)
    told = ship(vectors).sparkSession.sparkContext.broadcast(books)
    digits = [f"{i:02x}" for i in range(max((len(c) for c in books), default=0))]

    def code(batches):
        for b in batches:
            if not b.num_rows:
                continue
            codes, errors = np.empty(b.num_rows, object), np.empty(b.num_rows, object)
            for rows, x in floors(_filled(matrix(b), parts), factor):
                at, error = _assign(x, told.value)
                codes[rows] = ["".join([digits[i] for i in r]) for r in at.tolist()]
                errors[rows] = error
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(codes.tolist(), pa.string()), as_long(errors)],
                ["vec_id", "label", "code", "error"])

    return (vectors.select("vec_id", "label", "v")
            .mapInArrow(code, f"vec_id long, label {label.dataType.simpleString()}, code string, error long"))


def compress(table: DataFrame, factor: int = FACTOR, parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256."""
    vectors = usable(table, extra=("label",))
    books = fit(vectors, factor, parts, entries, rounds)
    if not books:
        coded = vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = cut(assign(vectors, books, factor), "codes")
    wide = F.sum(F.col("error").cast("decimal(38,0)"))
    whole = F.when(F.count("error") == F.count("*"), wide)
    sums = coded.groupBy("label").agg(F.count("*").alias("c"), whole.alias("s"))
    sums = cut(sums.select("label", "c", F.expr("try_cast(s AS long)").alias("label_error")), "label-errors")
    return add_unique(coded, sums, "label", "c").select(
        "vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
