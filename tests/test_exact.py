import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sellerlens import names as N
from sellerlens.functions import exact
from sellerlens.operators import chartdata
from sellerlens.sources import fixtures
from tests.conftest import SF_SMALL, rows


def true_sum(values):
    total = sum(map(Fraction, values))
    return total.numerator / total.denominator          # rounded once


def spark_sum(spark, values, parts=8):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)
    return df.agg(exact.exact_sum(F.col("x")).alias("s")).first()[0]


CASES = {
    "money": lambda r: [round(r.uniform(-1e6, 1e6), r.choice([0, 2, 3])) for _ in range(3000)],
    "cancel": lambda r: [x for _ in range(400) for y in [r.uniform(0, 1e15)] for x in (y, -y, 0.01)],
    "mixed": lambda r: [r.choice([-1, 1]) * 2.0 ** r.randrange(-18, 62) * r.random() for _ in range(2000)],
    "tenths": lambda r: [0.1] * 1000 + [-0.3] * 7,
    "negative": lambda r: [-1e-5, -2 ** -18.5, -0.0, -123456789.123],
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_is_the_true_sum_in_any_order(spark, case):
    r = random.Random(3)
    values = CASES[case](r)
    want = true_sum(values)
    for parts in (1, 3, 16):
        r.shuffle(values)
        assert spark_sum(spark, values, parts) == want


def test_nulls_and_values_without_lanes(spark):
    inf = float("inf")
    assert spark_sum(spark, [None, None]) is None and spark_sum(spark, [None, 2.5, None]) == 2.5
    assert spark_sum(spark, [1.0, inf, 3.0]) == inf and math.isnan(spark_sum(spark, [inf, -inf, 1.0]))
    assert math.isnan(spark_sum(spark, [1.0, float("nan")])) and spark_sum(spark, [2.0 ** 63, 1.5, -(2.0 ** 63)]) == 1.5
    assert spark_sum(spark, [2.0 ** -60, 2.0 ** -73]) == 2.0 ** -60          # below the lowest lane
    df = spark.createDataFrame([], "x double")
    assert df.agg(exact.exact_sum(F.col("x")).alias("s")).first()[0] is None


def test_sums_of_sums_count_every_row(spark):
    r = random.Random(9)
    data = [(r.randrange(20), round(r.uniform(-1e5, 1e5), 2), r.randrange(1, 5)) for _ in range(3000)]
    per = {}
    for k, x, _ in data:
        per.setdefault(k, []).append(x)
    times = {k: r.randrange(1, 9) for k in per}
    df = spark.createDataFrame(data, "k long, x double, n long")
    sums = df.groupBy("k").agg(*exact.lane_sums(F.col("x"), "s_"))
    sums = sums.join(spark.createDataFrame(list(times.items()), "k long, t long"), "k")
    got = sums.agg(exact.exact_sum_of_lanes("s_", F.col("t")).alias("s")).first()[0]
    assert got == true_sum([x for k, xs in per.items() for x in xs * times[k]])
    weighted = df.agg(exact.exact_sum(F.col("x"), F.col("n")).alias("s")).first()[0]
    assert weighted == true_sum([x for _, x, n in data for _ in range(n)])


def test_reports_do_not_depend_on_partitioning(spark):
    from sellerlens import catalog
    from sellerlens.operators import reports
    t = catalog.tables(spark, SF_SMALL)
    one, many = ((t.orders.repartition(n), t.income.repartition(n)) for n in (1, 13))
    for report in (reports.region_analysis, reports.product_analysis):
        assert rows(report(*one)) == rows(report(*many))
    assert rows(reports.income_by_month(one[1])) == rows(reports.income_by_month(many[1]))


# -- wide series (V-4) ---------------------------------------------------------

def long_form(spark, data):
    return spark.createDataFrame(data, f"`{N.MONTH_VN}` string, `{N.PRODUCT_KIND}` string, `{N.TOTAL_QUANTITY}` long")


def wide(df, **k):
    return chartdata.to_wide(df, N.MONTH_VN, N.PRODUCT_KIND, N.TOTAL_QUANTITY, **k)


def test_wide_tells_absent_from_zero(spark):
    df = wide(long_form(spark, [("2024-02", "b", 0), ("2024-01", "a", 5), ("2024-02", "a", None), (None, "c", 7)]))
    assert df.columns == [N.MONTH_VN, "a", "b", "c"]
    assert [tuple(r) for r in df.collect()] == [("2024-01", 5, None, None), ("2024-02", None, 0, None), (None, None, None, 7)]


def test_wide_names_and_null_series(spark):
    df = wide(long_form(spark, [("m", "X.y", 1), ("m", "x.Y", 2), ("m", None, 3), ("m", "null", 4), ("m", N.MONTH_VN, 5)]))
    assert len({x.lower() for x in df.columns}) == 6
    assert dict(zip(df.columns, df.first())) == {
        N.MONTH_VN: "m", "X.y": 1, "x.Y_1": 2, N.MONTH_VN + "_1": 5, "null": 4, "null_1": 3}


def test_too_many_series_stay_long(spark):
    data = [(f"m{i % 3}", f"s{i}", i) for i in range(30)]
    assert wide(long_form(spark, data), widest=29).columns == [N.MONTH_VN, N.PRODUCT_KIND, N.TOTAL_QUANTITY]
    assert len(wide(long_form(spark, data), widest=30).columns) == 31
    assert wide(long_form(spark, [])).collect() == []


def test_wide_holds_the_same_cells_as_the_long_form(spark):
    from sellerlens import catalog
    long = {(r[0], r[1]): r[2] for r in rows(catalog.QUERIES["sku_monthly"](spark, SF_SMALL),
                                              N.MONTH_VN, N.PRODUCT_KIND, N.TOTAL_QUANTITY)}
    got = catalog.QUERIES["sku_monthly_pivot"](spark, SF_SMALL)
    cells = {(r[N.MONTH_VN], k): r[k] for r in got.collect() for k in got.columns[1:] if r[k] is not None}
    assert cells == long
