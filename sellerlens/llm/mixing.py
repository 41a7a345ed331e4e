"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted in cells, one per combination of source, language and
topic. Raking scales the cells' token weights until every marginal equals its
target, under the bound that no cell gives more tokens than it has: cells that
reach it are fixed at probability one and the others raked on. A value whose
target exceeds its tokens gives all of them and the others share the rest
(``marginals`` names these). Probabilities are the weights per token. A document is sampled when its hash falls below its probability, so
the choice is repeatable and needs no shuffle.

Up to ``CELLS`` cells are raked in numpy on the driver, more by repeated
aggregations in Spark; both take the same steps.

Defined cases: null source, language or topic is a value of its own; null and
empty texts have no tokens and the probability of their cell; a cell without
any token weight keeps its documents with the wanted share; repeated rows
count and are sampled alike; a null doc_id is drawn by its text; a target for an absent value is ignored, values
without a target keep their own share; an empty table gives no rows; extra
columns are carried along.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sellerlens.llm.rules import SPACE
from sellerlens.llm.work import cut, free, small_side

CELLS = 100_000
SWEEPS = 300           # ends only targets that contradict each other; others meet TOLERANCE before
TOLERANCE = 1e-9
FARTHEST = 1e6         # times its tokens that a cell's weight may pass its cap
NULL = "\x00"

# A topic is the first whose pattern the text has; others are prose.
TOPICS: tuple[tuple[str, str], ...] = (
    ("license", r"(?i)\b(copyright|licen[sc]e[ds]?|all rights reserved)\b"),
    ("contact", r"\w@[\w-]+\.\w|\d[\d() -]{8,}\d"),
    ("markup", r"[#*$%&|<>]{3}| \| [^|]{1,60} \| "),
)


def topic(text: Column, topics=TOPICS) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(topics):
        out = F.when(F.rlike(text, F.lit(pattern)), name).otherwise(out)
    return F.when(text.isNotNull(), out)


def tokens(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE), lambda w: w != "")), F.lit(0)).cast("long")


def _targets(totals: dict[str, float], target, share: float) -> dict[str, tuple[float, float]]:
    """Per value of a dimension the wanted tokens, and those within reach: no
    value can give more than it has, and what one lacks is spread over the
    others in proportion. A number is an exponent: shares in proportion to
    tokens to that power. A dict lists shares."""
    whole = sum(totals.values())
    if not isinstance(target, dict):
        raised = {v: t ** target if t > 0 else 0.0 for v, t in totals.items()}
    else:
        raised = {v: target.get(v, t / whole) if t > 0 else 0.0 for v, t in totals.items()}
    all_ = sum(raised.values()) or 1.0
    wanted = {v: share * whole * r / all_ for v, r in raised.items()}
    reach, short = dict(wanted), set()
    while over := {v for v, x in reach.items() if v not in short and x > totals[v]}:
        short |= over
        rest = share * whole - sum(totals[v] for v in short)
        open_ = sum(w for v, w in wanted.items() if v not in short)
        reach = {v: totals[v] if v in short else rest * w / open_ if open_ else 0.0 for v, w in wanted.items()}
    return {v: (wanted[v], reach[v]) for v in totals}


def _factor(want, held, capped, open_):
    """Newton's step towards the factor at which the capped cells of a value
    hold ``want`` tokens: cells at their cap are fixed, the others take the
    rest. Where the fixed ones alone hold too much, all are scaled down."""
    step = np.divide(want - capped, open_, out=np.ones_like(want), where=open_ > 0)
    down = np.divide(want, held, out=np.ones_like(want), where=held > 0)
    return np.where((want > capped) | (want == 0), step, down)


def rake(cells: pd.DataFrame, dims: list[str], targets: dict, share: float) -> np.ndarray:
    """Expected tokens of every cell (columns ``dims`` and ``n``), ``n`` at
    most, at the reachable marginals."""
    n = cells["n"].to_numpy(float)
    w, off = n * share, 0.0
    coded = []
    for d in dims:
        code, values = pd.factorize(cells[d])
        aim = _targets(dict(zip(values, np.bincount(code, n, len(values)))), targets[d], share)
        coded.append((code, np.array([aim[v][1] for v in values])))
    coded.append((np.zeros(len(n), int), np.array([share * n.sum()])))
    for _ in range(SWEEPS):
        off = 0.0
        for code, want in coded:
            size = len(want)
            at_cap = w >= n
            held = np.bincount(code, np.minimum(w, n), size)
            off = max(off, np.abs(held - want).max(initial=0.0))
            f = _factor(want, held, np.bincount(code, n * at_cap, size), np.bincount(code, w * ~at_cap, size))
            w = np.minimum(w * f[code], n * FARTHEST)
        if off <= TOLERANCE * n.sum():
            break
    return np.minimum(w, n)


def rake_table(cells: DataFrame, dims: list[str], targets: dict, share: float) -> DataFrame:
    """The same steps for any number of cells, by combining aggregations:
    ``dims``, ``n`` and the expected tokens ``x``. Tables of a dimension's
    values stay in Spark, too."""
    whole = float(cells.agg(F.sum("n")).first()[0] or 0)
    t = cells.withColumn("w", F.col("n") * F.lit(share))
    for d in dims:
        reach = _reach_table(cells, d, targets[d], share, whole).select(d, F.col("reach").alias(f"want_{d}"))
        t = t.join(reach, d)
    t = cut(t.withColumn("want_", F.lit(share * whole)).withColumn("all_", F.lit(0)), "rake")
    groups = [*[(d, f"want_{d}") for d in dims], ("all_", "want_")]
    kept = t.columns
    for _ in range(SWEEPS):
        t = t.withColumn("off", F.lit(0.0))
        for d, want in groups:
            at_cap = F.col("w") >= F.col("n")
            sums = t.groupBy(d).agg(
                F.max(want).alias("goal"), F.sum(F.least("w", F.col("n").cast("double"))).alias("held"),
                F.sum(F.when(at_cap, F.col("n").cast("double")).otherwise(0.0)).alias("capped"),
                F.sum(F.when(at_cap, 0.0).otherwise(F.col("w"))).alias("open"))
            step = F.when(F.col("open") > 0, (F.col("goal") - F.col("capped")) / F.col("open")).otherwise(1.0)
            down = F.when(F.col("held") > 0, F.col("goal") / F.col("held")).otherwise(1.0)
            f = F.when((F.col("goal") > F.col("capped")) | (F.col("goal") == 0), step).otherwise(down)
            sums = cut(sums.select(d, f.alias("f"), F.abs(F.col("held") - F.col("goal")).alias("miss")), "rake")
            t = (t.join(small_side(sums), d)
                 .withColumn("w", F.least(F.col("w") * F.col("f"), F.col("n") * FARTHEST))
                 .withColumn("off", F.greatest("off", "miss")).select(*kept, "off"))
        t = cut(t, "rake")
        if (t.agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE * whole:
            break
    return t.select(*dims, "n", F.least("w", F.col("n").cast("double")).alias("x"))


def _reach_table(cells: DataFrame, d: str, target, share: float, whole: float) -> DataFrame:
    """``_targets`` as a table: d, tokens, wanted and reach. Column names of
    dimensions are those of ``_cells``, unlike any working column."""
    t = cells.groupBy(d).agg(F.sum("n").cast("double").alias("tokens"))
    if isinstance(target, dict):
        listed = F.lit(None).cast("double")
        for v, part in target.items():
            listed = F.when(F.col(d) == v, F.lit(float(part))).otherwise(listed)
        raw = F.when(F.col("tokens") > 0, F.coalesce(listed, F.col("tokens") / F.lit(whole or 1.0))).otherwise(0.0)
    else:
        raw = F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(float(target)))).otherwise(0.0)
    t = cut(t.select(d, "tokens", raw.alias("raw")), "rake")
    all_ = t.agg(F.sum("raw")).first()[0] or 1.0
    t = cut(t.select(d, "tokens", (F.col("raw") * F.lit(share * whole / all_)).alias("wanted"), F.lit(False).alias("short")), "rake")
    while True:
        held, open_ = t.agg(F.sum(F.when(F.col("short"), F.col("tokens")).otherwise(0.0)),
                            F.sum(F.when(F.col("short"), 0.0).otherwise(F.col("wanted")))).first()
        rest = (share * whole - (held or 0.0)) / open_ if open_ else 0.0
        reach = F.when(F.col("short"), F.col("tokens")).otherwise(F.col("wanted") * F.lit(rest))
        if t.where(~F.col("short") & (reach > F.col("tokens"))).isEmpty():
            return t.select(d, "tokens", "wanted", reach.alias("reach"))
        t = cut(t.withColumn("short", F.col("short") | (reach > F.col("tokens"))), "rake")


def names(documents: DataFrame) -> list[str]:
    """Names of the columns that ``mix`` adds: ``__tokens``, ``__probability``
    and ``__sampled``, unless columns of ``documents`` have them."""
    return free(documents.columns, "__tokens", "__probability", "__sampled")


def _cells(documents: DataFrame, targets: dict, topic_of: Column | None) -> tuple[DataFrame, list[str], str]:
    """``documents`` with their cell and tokens, and the names of those columns."""
    own = {"topic": topic(F.col("text")) if topic_of is None else topic_of}
    size, *keys = free(documents.columns, "__tokens", "__probability", "__sampled", *[f"__{d}" for d in targets])
    keys = keys[2:]
    key = [F.coalesce(own.get(d, F.col(f"`{d}`")).cast("string"), F.lit(NULL)).alias(k) for d, k in zip(targets, keys)]
    return documents.select("*", *key, tokens(F.col("text")).alias(size)), keys, size


def _chances(cells: DataFrame, keys: list[str], aims: dict, share: float, cells_on_driver: int) -> DataFrame:
    """keys, n and probability ``p`` of every cell."""
    if cells.count() <= cells_on_driver:
        c = cells.toPandas().sort_values(keys, ignore_index=True)                  # ``CELLS`` rows at most
        n = c["n"].to_numpy(float)
        x = rake(c, keys, aims, share)
        c["p"] = np.divide(x, n, out=np.full(len(n), float(share)), where=n > 0)
        schema = ", ".join(f"`{k}` string" for k in keys) + ", n long, p double"
        return F.broadcast(cells.sparkSession.createDataFrame(c[[*keys, "n", "p"]].values.tolist(), schema))
    t = rake_table(cells, keys, aims, share)
    return t.select(*keys, "n", F.when(F.col("n") > 0, F.col("x") / F.col("n")).otherwise(F.lit(float(share))).alias("p"))


def marginals(documents: DataFrame, targets: dict, share: float, topic_of: Column | None = None,
              cells_on_driver: int = CELLS) -> DataFrame:
    """dimension, value (null as itself), and as shares of the expected
    tokens: wanted; reachable, which is less than wanted where the value has
    too few tokens and more where others have; achieved by ``mix``. Where
    achieved is not reachable, the dimensions' targets contradict each other."""
    t, keys, size = _cells(documents, targets, topic_of)
    cells = cut(t.groupBy(*keys).agg(F.sum(size).alias("n")), "cells")
    aims = {k: targets[d] for d, k in zip(targets, keys)}
    p = cut(_chances(cells, keys, aims, share, cells_on_driver), "chances")
    whole = float(cells.agg(F.sum("n")).first()[0] or 0)
    part = F.lit(share * whole or 1.0)
    out = None
    for d, k in zip(targets, keys):
        got = p.groupBy(k).agg(F.sum(F.col("n") * F.col("p")).alias("x"))
        one = (_reach_table(cells, k, targets[d], share, whole).join(got, k)
               .select(F.lit(d).alias("dimension"), F.when(F.col(k) != NULL, F.col(k)).alias("value"),
                       (F.col("wanted") / part).alias("wanted"), (F.col("reach") / part).alias("reachable"),
                       (F.col("x") / part).alias("achieved")))
        out = one if out is None else out.unionByName(one)
    return out


def mix(documents: DataFrame, targets: dict, share: float, seed: int = 0, cells_on_driver: int = CELLS,
        topic_of: Column | None = None) -> DataFrame:
    """``documents`` with tokens, probability and whether it is sampled (``names``).

    ``targets`` maps "source", "lang" and "topic" (or other columns) to an
    exponent or a dict of shares; ``share`` is the part of all tokens to
    expect; ``topic_of`` gives topics of one's own in place of the patterns.
    """
    _, chance_of, sampled = names(documents)
    t, keys, size = _cells(documents, targets, topic_of)
    cells = cut(t.groupBy(*keys).agg(F.sum(size).alias("n")), "cells")
    aims = {k: targets[d] for d, k in zip(targets, keys)}
    told = _chances(cells, keys, aims, share, cells_on_driver).select(*keys, F.col("p").alias(chance_of))
    draw = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit(seed))).otherwise(F.xxhash64("text", F.lit(seed)))
    chance = F.shiftrightunsigned(draw, 11) / F.lit(float(1 << 53))
    out = t.join(told, keys)
    return out.select(*[f"`{c}`" for c in documents.columns], size, chance_of,
                      (chance < F.col(chance_of)).alias(sampled))
