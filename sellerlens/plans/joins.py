"""How order lines meet settlement entries.

The reports join ``orders."Order ID" = income."Related order ID"``, which is
many-to-many: an order has several lines and may have several entries.
Two plans are used:

* ``order_income`` – the row-level join, for reports that list rows
  (adjustments, searches). Both sides shuffle on the ID unless AQE finds
  one side small enough to broadcast at run time; a skewed ID partition is
  split by AQE's skew-join handling.
* ``lines_per_order`` ⋈ ``income_by_order`` – for reports that only
  aggregate over the join. Each side is first reduced to one row per
  (group key, order) and one row per order, with map-side combining, and
  the per-line measures are multiplied by the per-order entry count. The
  result equals aggregating the full fan-out, but the shuffle carries at
  most one row per order and group key per task, however hot an ID is,
  and the join is one-to-one on the entry side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sellerlens import names as N
from sellerlens.operators.income import income_by_order


# Pairs of order lines and settlement entries. An order ID is in one pair only,
# so that the join of all is the union of the pairs' joins.
Parts = Sequence[tuple[DataFrame, DataFrame]]


def _dedupe_names(left: Sequence[str], right: Sequence[str]) -> dict[str, str]:
    """Right-hand names renamed like a pandas fetch of ``SELECT *``: ``x_1``."""
    taken = set(left)
    out = {}
    for name in right:
        new = name
        k = 1
        while new in taken:
            new = f"{name}_{k}"
            k += 1
        taken.add(new)
        out[name] = new
    return out


def order_income(orders: DataFrame, income: DataFrame) -> DataFrame:
    """``SELECT * FROM orders o JOIN income i ON o."Order ID" = i."Related order ID"``.

    Order columns first, then income columns; an income column whose name
    is already taken gets a ``_1`` suffix.
    """
    ren = _dedupe_names(orders.columns, income.columns)
    inc = income.select(*[N.c(old).alias(new) for old, new in ren.items()])
    cond = N.c(N.ORDER_ID) == inc[f"`{ren[N.RELATED_ORDER_ID]}`"]
    return orders.join(inc, cond, "inner")


def lines_per_order(orders: DataFrame, keys: Sequence[Column | str],
                    measures: Mapping[str, Column] | None = None,
                    where: Column | None = None) -> DataFrame:
    """One row per (keys, order ID) with ``n_lines`` and summed ``measures``."""
    df = orders if where is None else orders.where(where)
    oid = N.c(N.ORDER_ID)
    aggs = [F.count(F.lit(1)).alias("n_lines")]
    aggs += [F.sum(expr).alias(name) for name, expr in (measures or {}).items()]
    key_cols = [N.c(k) if isinstance(k, str) else k for k in keys]
    return (df.where(oid.isNotNull())
              .groupBy(*key_cols, oid.alias("_oid"))
              .agg(*aggs))


def join_entries(lines: DataFrame, income: DataFrame) -> DataFrame:
    """``lines_per_order`` rows that have settlement entries, with
    ``n_inc`` and the revenue lanes of their order attached (inner join)."""
    per_order = income_by_order(income)
    return lines.join(per_order, lines["_oid"] == per_order["_rid"], "inner")


def joined_lines(parts: Parts, keys: Sequence[Column | str], measures: Mapping[str, Column] | None = None,
                 where: Column | None = None) -> DataFrame:
    """:func:`join_entries` of the lines and entries of all ``parts``."""
    return reduce(DataFrame.unionByName,
                  [join_entries(lines_per_order(o, keys, measures, where), i) for o, i in parts])


# Bits of the bitmap of ``maybe_among``, broadcast as a million words at most.
HASH_BITS = 1 << 26


def maybe_among(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``df`` without most rows whose ``key`` is not in the only column of
    ``ids``, before any shuffle: none whose key is there gets lost, some others
    stay (equal hashes). For a wide ``df`` ahead of an exact join."""
    h = lambda x: F.pmod(F.xxhash64(x), F.lit(HASH_BITS))
    bits = (ids.select(h(F.col(ids.columns[0])).alias("_h"))
               .select(F.shiftright("_h", 6).alias("_word"), F.expr("shiftleft(1L, CAST(_h & 63 AS int))").alias("_bit"))
               .groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    t = df.withColumn("_h", h(F.col(key)))
    t = t.join(F.broadcast(bits), F.shiftright(t["_h"], 6) == F.col("_word"))
    return t.where("shiftright(_bits, CAST(_h & 63 AS int)) & 1 = 1").select(*[N.c(x) for x in df.columns])
