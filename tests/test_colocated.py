"""Tables stored by order ID: same reports, no shuffle for the join."""

import uuid

import pytest
from pyspark.sql import functions as F

from sellerlens import catalog, names as N
from sellerlens.operators import reports as R
from sellerlens.plans.joins import join_entries, lines_per_order, order_income
from sellerlens.sinks import colocated as C
from sellerlens.sinks.colocated import attach, write_colocated
from sellerlens.sources.files import Tables
from tests.conftest import SF_SMALL, rows


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Tables in which one order has a third of all rows, and some have no ID."""
    t = catalog.tables(spark, SF_SMALL)
    hot = t.orders.where(N.c(N.ORDER_ID).isNotNull()).agg(F.min(N.c(N.ORDER_ID))).first()[0]

    def heat(df, key):
        turn = F.pmod(F.xxhash64(*[N.c(x) for x in df.columns]), F.lit(12))
        return df.withColumn(key, F.when(turn < 4, F.lit(hot)).when(turn > 4, N.c(key)))
    given = Tables(heat(t.orders, N.ORDER_ID), heat(t.income, N.RELATED_ORDER_ID).where(
        (N.c(N.RELATED_ORDER_ID) != hot) | (F.pmod(F.xxhash64(N.c(N.ADJUSTMENT_ID)), F.lit(50)) == 0)
        | N.c(N.RELATED_ORDER_ID).isNull()), t.overview)
    base, name = str(tmp_path_factory.mktemp("store")), "t" + uuid.uuid4().hex
    return given, write_colocated(spark, given, base, name, buckets=4), base, hot


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_rows_are_stored_once_and_hot_ids_apart(spark, stored):
    given, store, _, hot = stored
    for side, key in (("orders", N.ORDER_ID), ("income", N.RELATED_ORDER_ID)):
        main, apart = getattr(store, side), getattr(store, f"hot_{side}")
        assert sorted(map(str, main.unionByName(apart).collect())) == sorted(map(str, getattr(given, side).collect()))
        assert {r[0] for r in apart.select(N.c(key)).distinct().collect()} == {hot, None}
        assert main.where(N.c(key).isNull() | (N.c(key) == hot)).isEmpty()


def test_reports_equal_those_on_plain_tables(stored):
    given, store, _, _ = stored
    for report in (R.top_buyers, R.top_provinces, R.region_analysis, R.product_analysis):
        assert rows(report(store.orders, store.income, more=store.parts[1:])) == rows(report(given.orders, given.income))
    found = R.adjustments(store.orders, store.income, more=store.parts[1:])
    assert sorted(map(str, rows(found))) == sorted(map(str, rows(R.adjustments(given.orders, given.income))))


def test_no_exchange_under_the_join(spark, stored):
    _, store, base, _ = stored
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = attach(spark, base, "a" + uuid.uuid4().hex, 4)
        for s in (store, again):
            for keys in ([N.PROVINCE], [N.PRODUCT_NAME, N.SELLER_SKU]):
                p = plan(join_entries(lines_per_order(s.orders, keys), s.income))
                assert "SortMergeJoin" in p and "Exchange" not in p
            p = plan(order_income(s.orders, s.income))
            assert "SortMergeJoin" in p and "Exchange" not in p
        assert again.orders.count() == store.orders.count()
        whole = plan(R.region_analysis(store.orders, store.income))
        assert whole.count("Exchange hashpartitioning") == 1      # the provinces' totals
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_tables(spark, stored, tmp_path):
    given = stored[0]
    none = Tables(given.orders.limit(0), given.income.limit(0), given.overview)
    store = write_colocated(spark, none, str(tmp_path / "s"), "e" + uuid.uuid4().hex)
    assert rows(R.region_analysis(store.orders, store.income, more=store.parts[1:])) == []


def test_a_bucket_fits_a_task_and_few_are_written_unsorted():
    assert C.bucket_count(0) == C.LEAST_BUCKETS
    assert 47_000_000 / C.bucket_count(47_000_000) <= 500_000
    assert C.bucket_count(280_000_000) == C.MERGED
    assert 3_000_000_000 / C.bucket_count(3_000_000_000) <= C.MOST_ROWS


def test_parts_are_classified_each_for_themselves(spark, tmp_path, monkeypatch):
    t = catalog.tables(spark, SF_SMALL)
    calls = []
    real = C.classify_income
    monkeypatch.setattr(C, "classify_income", lambda df: calls.append(df) or real(df))
    store = write_colocated(spark, t, str(tmp_path / "s"), "p" + uuid.uuid4().hex, buckets=4)
    assert [df.count() for df in calls] == [store.hot_income.count(), store.income.count()]
    got = store.income.unionByName(store.hot_income)
    assert got.columns == t.income.columns
    assert sorted(map(str, rows(got))) == sorted(map(str, rows(t.income)))
