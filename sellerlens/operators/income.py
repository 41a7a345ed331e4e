"""Settlement classification (IN-1 … IN-13).

Every label depends only on two group sizes and one group flag:

* ``n_rid``  – entries sharing the ``Related order ID``        (Classify, type)
* ``n_pair`` – entries sharing (related ID, adjustment ID)      (Paydouble)
* ``comp``   – some entry of the related ID is an adjustment: its adjustment
  ID starts with ``7`` or its ``Type`` is not ``Order`` (null counts as not
  Order)

These are computed as aggregations, not as window functions. An aggregation
combines rows inside each task before the shuffle, so a hot ID (say a third
of all entries share one related ID, or the IDs are null) shrinks to one
row per task instead of landing whole in one task, as a window partition
would. The statistics (one row per distinct ID pair, and per related ID)
are then joined back to the entries; Spark broadcasts them when AQE
measures them small and otherwise sort-merges, splitting a skewed entry
partition. Null IDs form one group, as the pandas original grouped them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sellerlens import names as N
from sellerlens.functions.exact import lane_sums
from sellerlens.functions.text import starts_with_text, with_settled_date
from sellerlens.sources.files import refuse_floating_ids, strip_headers


def ids_as_text(df: DataFrame) -> DataFrame:
    """IN-4: both IDs as text (string or integer input). Floating-point IDs
    have lost digits and would miss in every join, so they are refused."""
    refuse_floating_ids(df, (N.ADJUSTMENT_ID, N.RELATED_ORDER_ID))
    return df.withColumns({
        N.ADJUSTMENT_ID: N.c(N.ADJUSTMENT_ID).cast("string"),
        N.RELATED_ORDER_ID: N.c(N.RELATED_ORDER_ID).cast("string"),
    })


def adjustment_signal(adj: Column | None = None, typ: Column | None = None) -> Column:
    """IN-5 | IN-6 for one entry: ID starts with 7, or Type is not 'Order'."""
    adj = N.c(N.ADJUSTMENT_ID) if adj is None else adj
    typ = N.c(N.TYPE) if typ is None else typ
    return (starts_with_text(adj, N.ADJUSTMENT_PREFIX)
            | ~typ.cast("string").eqNullSafe(F.lit(N.TYPE_ORDER)))


def _norm(col: Column) -> tuple[Column, Column]:
    """A nullable key as two never-null columns (text or "", is-null flag).

    Equality on both equals null-safe equality on the key but stays a plain
    equi-join, which Catalyst can drop when a query reads no label (a
    null-safe ``<=>`` join is never dropped)."""
    return F.coalesce(col, F.lit("")), col.isNull()


def _pair_stats(df: DataFrame) -> DataFrame:
    """Per (related ID, adjustment ID), keys normalised (``_rk, _rn, _ak,
    _an``): ``n_pair`` and ``_comp_pair``. Combined map-side before the
    shuffle, so a hot ID pair (or the null IDs) arrives as one row per task."""
    rk, rn = _norm(N.c(N.RELATED_ORDER_ID))
    ak, an = _norm(N.c(N.ADJUSTMENT_ID))
    return (df.groupBy(rk.alias("_rk"), rn.alias("_rn"), ak.alias("_ak"), an.alias("_an"))
              .agg(F.count(F.lit(1)).alias("n_pair"),
                   F.bool_or(adjustment_signal()).alias("_comp_pair")))


def _id_stats(pairs: DataFrame) -> DataFrame:
    """Per related ID: ``n_rid`` and ``comp``, summed from the pair rows."""
    return (pairs.groupBy(F.col("_rk").alias("_irk"), F.col("_rn").alias("_irn"))
                 .agg(F.sum("n_pair").alias("n_rid"), F.bool_or("_comp_pair").alias("comp")))


def group_stats(df: DataFrame) -> DataFrame:
    """IN-2, IN-3, IN-7, IN-8 as one row per distinct (related ID, adjustment ID).

    Columns: the two IDs, ``n_pair``, ``n_rid``, ``comp``.
    """
    pairs = _pair_stats(ids_as_text(strip_headers(df)))
    ids = _id_stats(pairs)
    j = pairs.join(ids, (F.col("_rk") == F.col("_irk")) & (F.col("_rn") == F.col("_irn")), "left")
    return j.select(F.when(~F.col("_rn"), F.col("_rk")).alias(N.RELATED_ORDER_ID),
                    F.when(~F.col("_an"), F.col("_ak")).alias(N.ADJUSTMENT_ID),
                    "n_pair", "n_rid", "comp")


def _labels(n_rid: Column, n_pair: Column, comp: Column) -> dict[str, Column]:
    return {
        N.CLASSIFY: F.when(n_rid > 1, F.lit(N.DUPLICATE)).otherwise(F.lit(N.NOT_DUPLICATE)),
        N.PAYDOUBLE: F.when(n_pair > 1, F.lit(N.YES)).otherwise(F.lit(N.NO)),
        N.ORDER_TYPE: (F.when(comp, F.lit(N.COMPENSATION))
                        .when(n_rid > 1, F.lit(N.DOUBLE_PAID))
                        .otherwise(F.lit(N.NORMAL))),
    }


def attach_group_stats(df: DataFrame) -> DataFrame:
    """The entries (IDs as text) with ``n_pair``, ``n_rid`` and ``comp`` attached.

    The entries are scanned once more for the pair aggregation, whose shuffle
    serves twice: the per-ID totals are summed from the pairs. Both are joined back with left joins
    on unique, never-null keys, so every entry is kept exactly once, AQE
    can broadcast small statistics or split a skewed entry partition, and
    when a query reads none of the three columns Catalyst removes the joins
    and both aggregations from the plan.
    """
    df = ids_as_text(strip_headers(df))
    rk, rn = _norm(N.c(N.RELATED_ORDER_ID))
    ak, an = _norm(N.c(N.ADJUSTMENT_ID))
    pairs = _pair_stats(df)
    ids = _id_stats(pairs)
    j = (df.join(ids, (rk == ids["_irk"]) & (rn == ids["_irn"]), "left")
           .join(pairs, (rk == pairs["_rk"]) & (rn == pairs["_rn"])
                 & (ak == pairs["_ak"]) & (an == pairs["_an"]), "left"))
    # The pair's own flag is part of ``comp`` already. Read here, it makes both
    # uses of the pair aggregation identical, so that its shuffle is reused.
    return (j.withColumn("comp", F.col("comp") | F.col("_comp_pair"))
             .drop("_irk", "_irn", "_rk", "_rn", "_ak", "_an", "_comp_pair"))


def attach_id_stats(df: DataFrame) -> DataFrame:
    """The entries (IDs as text) with ``n_rid`` and ``comp`` attached.

    One aggregation per related ID (combined map-side, so a hot ID or the
    null IDs arrive as one row per task) and one left join on its unique key;
    labels that do not need the ID pair use this cheaper plan.
    """
    df = ids_as_text(strip_headers(df))
    rk, rn = _norm(N.c(N.RELATED_ORDER_ID))
    ids = (df.groupBy(rk.alias("_irk"), rn.alias("_irn"))
             .agg(F.count(F.lit(1)).alias("n_rid"), F.bool_or(adjustment_signal()).alias("comp")))
    return df.join(ids, (rk == ids["_irk"]) & (rn == ids["_irn"]), "left").drop("_irk", "_irn")


def classify_income(df: DataFrame) -> DataFrame:
    """IN-13: the whole income preparation.

    Output: the input columns (IDs as text, ``Order settled time`` as DATE),
    then ``ABS_Total_Fees``, ``Classify``, ``Paydouble``, ``Actually Order Type``.
    """
    df = ids_as_text(strip_headers(df))
    joined = attach_group_stats(df)
    labels = _labels(F.col("n_rid"), F.col("n_pair"), F.col("comp"))
    out = joined.select(
        *[N.c(col) for col in df.columns],
        F.abs(N.c(N.TOTAL_FEES)).alias(N.ABS_FEES),
        *[expr.alias(name) for name, expr in labels.items()],
    )
    return with_settled_date(out, N.SETTLED_TIME, N.SETTLED_TIME)


def _one_label(df: DataFrame, name: str) -> DataFrame:
    paired = name == N.PAYDOUBLE
    joined = attach_group_stats(df) if paired else attach_id_stats(df)
    n_pair = F.col("n_pair") if paired else F.lit(None)
    expr = _labels(F.col("n_rid"), n_pair, F.col("comp"))[name]
    return joined.withColumn(name, expr).drop("n_pair", "n_rid", "comp")


def flag_duplicates(df: DataFrame) -> DataFrame:
    """IN-2: ``Classify`` = Duplicate for every entry of a repeated related ID."""
    return _one_label(df, N.CLASSIFY)


def flag_paydouble(df: DataFrame) -> DataFrame:
    """IN-3: ``Paydouble`` = Yes for every entry of a repeated ID pair."""
    return _one_label(df, N.PAYDOUBLE)


def order_type(df: DataFrame) -> DataFrame:
    """IN-10: ``Actually Order Type`` (Compensation / DoublePaid / Normal)."""
    return _one_label(df, N.ORDER_TYPE)


def group_size(df: DataFrame) -> DataFrame:
    """IN-7: ``n_rid``, the number of entries sharing the related ID."""
    return attach_id_stats(df).drop("comp")


def group_any(df: DataFrame) -> DataFrame:
    """IN-8: ``comp``, whether any entry of the related ID is an adjustment."""
    return attach_id_stats(df).drop("n_rid")


def prefix_flag(df: DataFrame) -> DataFrame:
    """IN-5: ``starts_with_7`` on the adjustment ID text (null -> False)."""
    df = ids_as_text(strip_headers(df))
    return df.withColumn("starts_with_7", starts_with_text(N.c(N.ADJUSTMENT_ID), N.ADJUSTMENT_PREFIX))


def abs_fees(df: DataFrame) -> DataFrame:
    """IN-1 alone."""
    return df.withColumn(N.ABS_FEES, F.abs(N.c(N.TOTAL_FEES)))


def income_by_order(income: DataFrame) -> DataFrame:
    """Settlement entries summed per related order (non-null IDs).

    One row per order: ``_rid``, ``n_inc`` (entries) and the lanes ``rev_…``
    of the exact sum of ``Total revenue``. Joining order lines to this
    instead of to the entries gives the same totals as the many-to-many
    join without materialising its fan-out.
    """
    rid = N.c(N.RELATED_ORDER_ID).cast("string")
    return (income.where(rid.isNotNull())
                  .groupBy(rid.alias("_rid"))
                  .agg(F.count(F.lit(1)).alias("n_inc"), *lane_sums(N.c(N.TOTAL_REVENUE), "rev_")))
