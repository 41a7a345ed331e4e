"""Settlements shared out to lines add up, line by line and in every group."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sellerlens import catalog, names as N
from sellerlens.operators import apportion as A
from sellerlens.plans.numbering import places
from tests.conftest import SF_SMALL, rows

ORDERS = f"`{N.ORDER_ID}` string, `{N.SKU_ID}` string, `{N.QUANTITY}` double"
INCOME = f"`{N.RELATED_ORDER_ID}` string, `{N.SETTLEMENT}` double"


def brute(lines, entries):
    totals = defaultdict(int)
    for rid, x in entries:
        if rid is not None:
            totals[rid] += round(Fraction(abs(x * 100)) + Fraction(1, 10**9)) * (-1 if x < 0 else 1) if x is not None else 0
    out, own = [], defaultdict(list)
    for line in lines:
        if line[0] in totals:
            own[line[0]].append(line)
        else:
            out.append((*line, None))
    for oid, ls in own.items():
        total, w = totals[oid], [int(1000 * max(q or 0, 0)) for _, _, q in ls]
        if not sum(w):
            w = [1] * len(ls)
        whole = [abs(total) * x // sum(w) for x in w]
        left = abs(total) - sum(whole)
        order = sorted(range(len(ls)), key=lambda i: (-(abs(total) * w[i] % sum(w)), ls[i][1] is not None, ls[i][1] or "",
                                                      ls[i][2] is not None, ls[i][2] or 0))
        for i in order[:left]:
            whole[i] += 1
        out += [(*line, u * (-1 if total < 0 else 1)) for line, u in zip(ls, whole)]
    return Counter(out)


@pytest.mark.parametrize("seed", range(2))
def test_against_plain_loops(spark, seed, many_partitions):
    r = random.Random(seed)
    ids = ["hot"] * 8 + [f"o{i}" for i in range(12)] + [None]
    lines = [(r.choice(ids), r.choice(["a", "b", "c", None]), r.choice([0.0, 1.0, 1.0, 2.5, 3.0, 7.0, None, -1.0])) for _ in range(250)]
    lines += [("zero", "a", 0.0), ("zero", "b", None), ("zero", "b", None), ("alone", "a", 1.0)]
    entries = [(r.choice([*ids, "zero", "nolines"]), r.choice([10.0, 0.01, -3.33, 99.99, 0.0, None, 12345.67])) for _ in range(60)]
    entries.append(("zero", 0.05))
    o, i = spark.createDataFrame(lines, ORDERS), spark.createDataFrame(entries, INCOME)
    assert Counter(rows(A.share_out(o, i))) == brute(lines, entries)


def test_group_totals_add_up_to_the_settled_total(spark):
    t = catalog.tables(spark, SF_SMALL)
    want = t.income.agg(F.sum(F.round(N.c(N.SETTLEMENT) * 100).cast("long"))).first()[0]
    for key in (N.SKU_CATEGORY, N.PROVINCE, N.ORDER_MONTH, N.SELLER_SKU):
        found = rows(A.settled_by(t.orders, t.income, key), A.SETTLED)
        assert sum(round(x * 100) for x, in found) == want
    # and the lines of every order to its own
    shares = A.share_out(t.orders, t.income).groupBy(N.c(N.ORDER_ID).alias("o")).agg(F.sum(N.c(A.SHARE)).alias("s"))
    both = shares.join(A._settled(t.income, N.SETTLEMENT), F.col("o") == F.col("_sid"))
    assert both.where("NOT (s <=> _total)").isEmpty() and not both.isEmpty()


@pytest.fixture
def many_partitions(spark):
    """Small data as large data would be: AQE puts no partitions together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_hot_order_is_ranked_by_many_tasks(spark, many_partitions):
    lines = spark.range(20_000).selectExpr(f"'hot' AS `{N.ORDER_ID}`", f"CAST(id AS string) AS `{N.SKU_ID}`", f"id % 7 + 1 AS `{N.QUANTITY}`")
    ranked = places(lines.withColumn("g", F.lit("hot")), "g", [F.asc(N.c(N.SKU_ID))], "place")
    assert sorted(x for x, in rows(ranked, "place")) == list(range(20_000))
    assert [x for x, in rows(ranked.orderBy("place"), N.SKU_ID)] == sorted(map(str, range(20_000)))
    files = {f.rsplit("/", 1)[0] for f in ranked.inputFiles()}
    sizes = [n for n, in spark.read.parquet(*files).groupBy(F.shiftright("_row", 33).alias("p")).count().select("count").collect()]
    assert len(sizes) > 1 and max(sizes) < 15_000
    income = spark.createDataFrame([("hot", 123.45)], INCOME)
    assert A.share_out(lines, income).agg(F.sum(N.c(A.SHARE))).first()[0] == 12345


def test_empty(spark):
    o, i = spark.createDataFrame([], ORDERS), spark.createDataFrame([], INCOME)
    assert rows(A.share_out(o, i)) == []
    assert rows(A.settled_by(o, i, N.SKU_ID)) == [(None, 0.0, False)]
