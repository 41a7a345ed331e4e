"""Sums of doubles that do not depend on the order of addition.

Every double is split on fixed powers of two into integer lanes of 24 bits
(weights 2^-72 to 2^48). Lanes are longs, and adding longs is exact in any
order and partitioning; the lanes' sums are put together once, at the end,
with the rounding errors of that carried along. So the result is the same to
the last bit for any number of tasks, and is the true sum, rounded once.

Bounds: bits below 2^-72 are dropped from each value; a lane overflows at
2^39 values (5 x 10^11) in one group, which fails in ANSI mode; values of 2^63
and more, infinities and NaN are added as doubles beside the lanes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 24
LANES = 6
LOWEST = -72               # weight of the first lane, a power of two
_MASK = (1 << BITS) - 1


def _ordinary(x: Column) -> Column:
    return F.abs(x) < float(1 << 63)           # false for NaN


def lanes(x: Column) -> list[Column]:
    """The lanes of a double (null for null), lowest weight first; all zero
    for values that have none."""
    x = F.when(_ordinary(x), x).when(x.isNotNull(), 0.0)
    whole = x.cast("long")
    part = (x - whole) * float(1 << 2 * BITS)                  # exact: a shift
    high = part.cast("long")
    low = ((part - high) * float(1 << BITS)).cast("long")

    def split(v: Column, last: bool) -> list[Column]:
        return [v.bitwiseAND(_MASK), F.shiftright(v, BITS) if last else F.shiftright(v, BITS).bitwiseAND(_MASK)]

    return [low, *split(high, True), *split(whole, False), F.shiftright(whole, 2 * BITS)]


def beyond(x: Column) -> Column:
    """What has no lanes: infinities, NaN and values of 2^63 and more."""
    return F.when(~_ordinary(x), x)


def recombine(sums: list[Column], rest: Column) -> Column:
    """The double of summed lanes (null if they are null) and ``rest``."""
    terms = []
    for i, s in enumerate(sums):
        weight = 2.0 ** (LOWEST + BITS * i)
        # Two halves, each exact as a double.
        terms += [s.bitwiseAND(0xFFFFFFFF).cast("double") * weight, F.shiftright(s, 32).cast("double") * (weight * 2.0 ** 32)]

    def add(state: Column, t: Column) -> Column:
        s = state["s"] + t
        b = s - state["s"]
        return F.struct(s.alias("s"), (state["e"] + ((state["s"] - (s - b)) + (t - b))).alias("e"))

    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("e"))
    total = F.aggregate(F.array(*terms[::-1]), start, add, lambda z: z["s"] + z["e"])
    return F.when(sums[0].isNotNull(), F.coalesce(rest + total, total))


def exact_sum(x: Column, times: Column | None = None) -> Column:
    """Aggregate: the sum of a double column (each value ``times`` times, a
    long), independent of order; null without any value."""
    x = x.cast("double")
    n = F.lit(1).cast("long") if times is None else times
    rest = beyond(x) if times is None else beyond(x) * times
    return recombine([F.sum(lane * n) for lane in lanes(x)], F.sum(rest))


def lane_sums(x: Column, prefix: str) -> list[Column]:
    """Aggregates ``<prefix>0`` … and ``<prefix>rest``, to be summed further
    by :func:`exact_sum_of_lanes`."""
    x = x.cast("double")
    return [*[F.sum(lane).alias(f"{prefix}{i}") for i, lane in enumerate(lanes(x))],
            F.sum(beyond(x)).alias(f"{prefix}rest")]


def exact_sum_of_lanes(prefix: str, times: Column) -> Column:
    """Aggregate over rows of :func:`lane_sums`, each counted ``times`` times."""
    return recombine([F.sum(F.col(f"{prefix}{i}") * times) for i in range(LANES)],
                     F.sum(F.col(f"{prefix}rest") * times))


def exact_avg(x: Column) -> Column:
    """Aggregate: the exact sum divided by the number of values."""
    return exact_sum(x) / F.count(x)
