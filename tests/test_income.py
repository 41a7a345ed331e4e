"""Settlement classification: edge rows, a brute-force model, plan shape."""

from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from sellerlens import names as N
from sellerlens.operators import income as I
from sellerlens.operators import reports as R
from tests.conftest import rows

SCHEMA = ("`Order/adjustment ID` string, `Related order ID` string, `Type` string, "
          "`Total revenue` double, `Total fees` double, `Total settlement amount` double, "
          "`Order settled time` string")


def entries(spark, triples):
    data = [(a, r, t, 10.0, -1.0, 9.0, "2024/01/05") for a, r, t in triples]
    return spark.createDataFrame(data, SCHEMA)


EDGE = [
    ("51", "51", "Order"),
    ("52", "52", "Order"), ("52", "52", "Order"),
    ("53", "53", "Order"), ("753", "53", "Fee"),
    ("54", "54", None),
    ("755", "55", "Order"),
    ("56", "56", "Order"), ("57", "56", "Order"),
    ("a", None, "Order"), ("a", None, "Order"),
]
EXPECTED = {
    ("51", "51"): ("Not Duplicate", "No", "Normal"),
    ("52", "52"): ("Duplicate", "Yes", "DoublePaid"),
    ("53", "53"): ("Duplicate", "No", "Compensation"),
    ("753", "53"): ("Duplicate", "No", "Compensation"),
    ("54", "54"): ("Not Duplicate", "No", "Compensation"),
    ("755", "55"): ("Not Duplicate", "No", "Compensation"),
    ("56", "56"): ("Duplicate", "No", "DoublePaid"),
    ("57", "56"): ("Duplicate", "No", "DoublePaid"),
    ("a", None): ("Duplicate", "Yes", "DoublePaid"),
}


def test_classify_edge_rows(spark):
    out = I.classify_income(entries(spark, EDGE))
    got = rows(out, N.ADJUSTMENT_ID, N.RELATED_ORDER_ID, N.CLASSIFY, N.PAYDOUBLE, N.ORDER_TYPE)
    assert len(got) == len(EDGE)
    for adj, rid, *labels in got:
        assert tuple(labels) == EXPECTED[(adj, rid)], (adj, rid)


def test_classify_columns_and_types(spark):
    out = I.classify_income(entries(spark, EDGE))
    assert out.columns == [N.ADJUSTMENT_ID, N.RELATED_ORDER_ID, N.TYPE, N.TOTAL_REVENUE,
                           N.TOTAL_FEES, N.SETTLEMENT, N.SETTLED_TIME, N.ABS_FEES,
                           N.CLASSIFY, N.PAYDOUBLE, N.ORDER_TYPE]
    assert out.schema[N.SETTLED_TIME].dataType.simpleString() == "date"
    assert {r[N.ABS_FEES] for r in out.collect()} == {1.0}


def test_integer_ids_become_text(spark):
    df = spark.createDataFrame([(7001, 5001, "Order", 1.0, -1.0, 0.0, "2024/1/1")],
                               SCHEMA.replace("`Order/adjustment ID` string", "`Order/adjustment ID` bigint")
                                     .replace("`Related order ID` string", "`Related order ID` bigint"))
    out = I.classify_income(df).collect()[0]
    assert out[N.ADJUSTMENT_ID] == "7001" and out[N.ORDER_TYPE] == "Compensation"


def test_adjustments_list_only_typed_adjustment(spark):
    orders = spark.createDataFrame(
        [(r, "Completed", "SC_X1", 1, "01/01/2024 00:00:00") for r in ["51", "52", "53", "54", "55", "56"]],
        "`Order ID` string, `Order Status` string, `SKU Category` string, Quantity bigint, `Created Time` string")
    orders = orders.withColumn(N.CREATED_TS, orders[N.CREATED_TIME].cast("string"))
    got = rows(R.adjustments(orders, I.classify_income(entries(spark, EDGE))), N.ORDER_ID, N.TYPE)
    assert got == [("53", "Fee")]


def model(triples):
    """Plain-Python statement of the labels (null IDs grouped together)."""
    n_rid = Counter(r for _, r, _ in triples)
    n_pair = Counter((a, r) for a, r, _ in triples)
    comp = {}
    for a, r, t in triples:
        comp[r] = comp.get(r, False) or (a is not None and a.startswith("7")) or t != "Order"
    out = []
    for a, r, t in triples:
        typ = "Compensation" if comp[r] else ("DoublePaid" if n_rid[r] > 1 else "Normal")
        out.append((a, r, "Duplicate" if n_rid[r] > 1 else "Not Duplicate",
                    "Yes" if n_pair[(a, r)] > 1 else "No", typ))
    return sorted(out, key=repr)


ids = st.one_of(st.none(), st.sampled_from(["1", "2", "3", "71", "72"]))
types = st.one_of(st.none(), st.sampled_from(["Order", "Fee"]))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(ids, ids, types), min_size=1, max_size=12))
def test_classify_matches_model(spark, triples):
    out = I.classify_income(entries(spark, triples))
    got = sorted(rows(out, N.ADJUSTMENT_ID, N.RELATED_ORDER_ID, N.CLASSIFY, N.PAYDOUBLE, N.ORDER_TYPE), key=repr)
    assert got == model(triples)


def test_labels_partition_rows(spark):
    out = I.classify_income(entries(spark, EDGE))
    counts = Counter(r[N.ORDER_TYPE] for r in out.collect())
    assert sum(counts.values()) == len(EDGE)
    for r in out.collect():
        if r[N.PAYDOUBLE] == "Yes":
            assert r[N.CLASSIFY] == "Duplicate"


def test_unused_labels_are_pruned(spark):
    monthly = R.income_by_month(I.classify_income(entries(spark, EDGE)))
    plan = monthly._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert rows(monthly) == [("2024-01", 110.0, 99.0)]


def test_income_by_order(spark):
    got = sorted(rows(I.income_by_order(entries(spark, EDGE)), "_rid", "n_inc"))
    assert ("52", 2) in got and ("56", 2) in got and all(r[0] is not None for r in got)


def test_money_is_summed_as_it_is(spark):
    """Small, huge and infinite amounts."""
    for amounts, want in (([0.004] * 1000, 4.0), ([1e17, 1.0], 1e17), ([float("inf"), 5.0], float("inf"))):
        raw = spark.createDataFrame([("5", "1", "Order", a, 0.0, a, "2024/02/01") for a in amounts],
                                    "`Order/adjustment ID` string, `Related order ID` string, `Type` string, `Total revenue` double, "
                                    "`Total fees` double, `Total settlement amount` double, `Order settled time` string")
        got = rows(R.income_by_month(I.classify_income(raw)))[0][1]
        assert got == want or abs(got - want) < 1e-6 * max(1.0, abs(want)) if want != float("inf") else got == want
