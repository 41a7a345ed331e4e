"""Only lines that their columns must tell apart are ranked; the shares stay."""

import random
from collections import Counter

import pytest

from sellerlens import names as N
from sellerlens.operators import apportion as A
from sellerlens.plans.joins import maybe_among
from tests.conftest import rows
from tests.test_apportion import INCOME, ORDERS, brute


@pytest.mark.parametrize("many", [1, 3, 10_000])
def test_classes_and_ranking_give_the_same_shares(spark, many):
    r = random.Random(many)
    ids = ["hot"] * 6 + [f"o{i}" for i in range(15)] + [None]
    lines = [(r.choice(ids), r.choice(["a", "b", None]), r.choice([0.0, 1.0, 1.0, 2.0, 3.0, 7.0, None])) for _ in range(200)]
    entries = [(r.choice(ids), r.choice([10.0, 0.01, -3.33, 99.99, None])) for _ in range(40)]
    o, i = spark.createDataFrame(lines, ORDERS), spark.createDataFrame(entries, INCOME)
    assert Counter(rows(A.share_out(o, i, many=many))) == brute(lines, entries)


def test_lines_above_and_below_the_boundary_are_not_ranked(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(A, "places", lambda df, *a: (seen.append(df.count()), places(df, *a))[1])
    places = __import__("sellerlens.plans.numbering", fromlist=["places"]).places
    lines = [("x", str(k), float(k)) for k in range(1, 6)] + [("y", "a", 1.0), ("y", "b", 1.0), ("y", "c", 1.0)]
    entries = [("x", 1.01), ("y", 1.0)]
    o, i = spark.createDataFrame(lines, ORDERS), spark.createDataFrame(entries, INCOME)
    assert Counter(rows(A.share_out(o, i))) == brute(lines, entries)
    assert seen == [3]                     # of y alone: three lines alike, one unit left


def test_maybe_among_keeps_every_match_and_drops_most_others(spark):
    df = spark.range(20_000).selectExpr("CAST(id AS string) AS k", "id AS v")
    kept = {v for _, v in rows(maybe_among(df, "k", df.where("v % 10 = 0").select("k")))}
    assert {v for v in range(0, 20_000, 10)} <= kept and len(kept) < 2_100
    assert maybe_among(df, "k", df.where("false").select("k")).isEmpty()


def test_products_beyond_doubles_stay_exact(spark):
    lines = [("big", str(k), q) for k, q in enumerate([1e9, 3e9, 7e9, 1.0, 0.001])] + [("mix", "a", 3.0), ("mix", "b", 1e11)]
    entries = [("big", 9007199254740.99), ("big", -0.01), ("mix", 90071992547409.92)]
    o, i = spark.createDataFrame(lines, ORDERS), spark.createDataFrame(entries, INCOME)
    assert Counter(rows(A.share_out(o, i))) == brute(lines, entries)
