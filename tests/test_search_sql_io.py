"""Searches (with hostile input), ad hoc SQL, sources and the CSV sink."""

import json
import os

import pytest

from sellerlens import names as N
from sellerlens.operators import adhoc, search
from sellerlens.session import scratch_path
from sellerlens.sinks.csv import read_csv, write_csv
from sellerlens.sources.files import (OVERVIEW_TYPES, Tables, conform, load_tables,
                                      read_json_table, read_table)
from tests.conftest import rows
from tests.test_reports import ENTRIES, LINES, entry, make, order_line


def test_find_by_order(spark):
    o, i = make(spark, LINES, ENTRIES)
    got = search.find_by_order(o, i, "1")
    assert got.count() == 4
    assert N.RELATED_ORDER_ID in got.columns and N.ORDER_TYPE in got.columns


def test_injection_is_just_a_value(spark):
    o, i = make(spark, LINES, ENTRIES)
    for bad in ["x' OR '1'='1", "1' --", "'; DROP TABLE orders; --"]:
        assert search.find_by_order(o, i, bad).isEmpty()
        assert search.find_by_buyer(o, i, bad).isEmpty()
        assert search.find_by_sku(o, i, bad).isEmpty()
        assert search.find_by_city(o, i, bad).isEmpty()


def test_city_search_case_and_wildcards(spark):
    lines = [order_line("1", province="Da Nang City"), order_line("2", province="100%_x\\y")]
    o, i = make(spark, lines, [entry("1"), entry("2")])
    assert search.find_by_city(o, i, "đà nẵng").count() == 1
    assert search.find_by_city(o, i, "Da Nang").isEmpty()  # accents matter
    assert search.find_by_city(o, i, "%").count() == 2  # a wildcard unless literal
    assert search.find_by_city(o, i, "%", literal=True).count() == 1
    assert search.find_by_city(o, i, "\\y").count() == 1  # backslash is ordinary
    assert search.has_matches(search.find_by_city(o, i, "nẵng"))


DDL = {"string": "string", "double": "double"}


def test_match_counts(spark):
    o, i = make(spark, LINES, ENTRIES)
    got = dict(rows(search.match_counts(o, i, "1", "hà", "1", "b1")))
    assert got == {"order": 4, "city": 5, "sku": 6, "buyer": 5}


def test_find_by_buyer_columns(spark):
    o, i = make(spark, LINES, ENTRIES)
    assert search.find_by_buyer(o, i, "b1").columns == search.BUYER_COLUMNS


def _write_tables(spark):
    raw_o = spark.createDataFrame(LINES, ", ".join(
        f"`{c}` {'bigint' if c == N.QUANTITY else 'string'}" for c in N.ORDER_COLUMNS))
    raw_i = spark.createDataFrame(ENTRIES, "`Order/adjustment ID` string, `Related order ID` string, "
                                  "`Type` string, `Total revenue` double, `Total fees` double, "
                                  "`Total settlement amount` double, `Order settled time` string")
    raw_v = spark.createDataFrame([("2024-02-01", 3, 2, 0.5)],
                                  ", ".join(f"`{k}` {DDL.get(t.typeName(), 'bigint')}" for k, t in OVERVIEW_TYPES.items()))
    base = scratch_path(spark, "test-tables")
    for name, df in [("orders", raw_o), ("income", raw_i), ("overview", raw_v)]:
        df.write.parquet(f"{base}/{name}.parquet")
    return base


def test_load_tables_and_missing(spark):
    base = _write_tables(spark)
    t = load_tables(spark, f"{base}/orders.parquet", f"{base}/income.parquet", f"{base}/overview.parquet")
    assert isinstance(t, Tables) and t.orders.count() == len(LINES)
    assert load_tables(spark, f"{base}/nope.parquet", f"{base}/income.parquet", f"{base}/overview.parquet") is None
    assert read_table(spark, f"{base}/missing") is None


def test_conform_reports_missing_columns(spark):
    df = spark.createDataFrame([(" 1 ",)], "` Ngày ` string")
    try:
        conform(df, OVERVIEW_TYPES)
    except ValueError as e:
        assert "Lượt xem trang" in str(e)
    else:
        raise AssertionError("expected ValueError")


def test_json_array_source(spark, tmp_path):
    p = tmp_path / "users.json"
    p.write_text(json.dumps([{"username": "a", "password": "x"}, {"username": "b"}]), encoding="utf-8")
    df = read_json_table(spark, str(p), "username string, password string")
    assert sorted(rows(df)) == [("a", "x"), ("b", None)]
    assert read_json_table(spark, str(tmp_path / "none.json")) is None


def test_csv_sink_quoting(spark):
    df = spark.createDataFrame([("x,y", 'q"r', None, ""), ("plain", "z", "n", "e")],
                               "a string, b string, c string, d string")
    path = write_csv(df.coalesce(1), scratch_path(spark, "test-csv"))
    text = "".join(open(os.path.join(path, f), encoding="utf-8").read()
                   for f in sorted(os.listdir(path)) if f.endswith(".csv"))
    assert text.splitlines() == ["a,b,c,d", '"x,y","q""r",,', "plain,z,n,e"]
    back = rows(read_csv(spark, path, df.schema))
    assert ("x,y", 'q"r', None, None) in back


def test_adhoc_sql_dialect_and_params(spark):
    base = _write_tables(spark)

    def build(s):
        return load_tables(s, f"{base}/orders.parquet", f"{base}/income.parquet", f"{base}/overview.parquet")

    session = adhoc.sql_session(spark, build)
    q = ('SELECT strftime("Created_Timestamp", \'%Y-%m\') AS m, COUNT(*) AS n FROM orders '
         'WHERE "Order Status" = :s GROUP BY 1 ORDER BY 1')
    got = rows(adhoc.run_sql(session, q, {"s": "Completed"}))
    # Spark SQL puts NULL first in ascending order
    assert got == [(None, 1), ("2024-02", 2), ("2024-03", 2)]
    j = adhoc.run_sql(session, 'SELECT COUNT(*) AS n FROM orders o JOIN income i ON o."Order ID" = i."Related order ID"')
    assert rows(j) == [(6,)]  # order 1: 2 x 2, orders 2 and 4: 1 x 1
    # the caller's session does not see these views
    assert "orders" not in [t.name for t in spark.catalog.listTables()]


def test_persist_and_views(spark):
    o, i = make(spark, LINES, ENTRIES)
    ov = spark.createDataFrame([("2024-02-01", 3, 2, 0.5)],
                               ", ".join(f"`{k}` {DDL.get(t.typeName(), 'bigint')}" for k, t in OVERVIEW_TYPES.items()))
    t = Tables(o, i, ov).persist()
    try:
        assert t.orders.storageLevel.useDisk and t.income.is_cached
        assert t.orders.count() == len(LINES)
        session = spark.newSession()
        copy = Tables(*(session.createDataFrame(df.toPandas(), df.schema) for df in (t.orders, t.income, t.overview)))
        copy.register()
        assert session.sql("SELECT COUNT(*) FROM orders").collect()[0][0] == len(LINES)
    finally:
        t.unpersist()
    assert not t.orders.is_cached


def test_order_search_with_entries_equals_without(spark):
    from tests.test_reports import INCOME_SCHEMA
    o, i = make(spark, LINES, ENTRIES)
    e = spark.createDataFrame(ENTRIES, INCOME_SCHEMA)
    plain, narrowed = search.find_by_order(o, i, "1"), search.find_by_order(o, i, "1", e)
    assert plain.columns == narrowed.columns
    assert sorted(rows(plain), key=repr) == sorted(rows(narrowed), key=repr)


def test_csv_keeps_spaces_and_line_breaks(spark):
    df = spark.createDataFrame([(" Bình Thuận", "x "), ("  ", 'a\n"b", '), ("plain", "\ttab")], "a string, b string")
    path = write_csv(df, scratch_path(spark, "test-csv"))
    assert sorted(rows(read_csv(spark, path, df.schema, multi_line=True))) == sorted(rows(df))


@pytest.mark.parametrize("fmt, want", [
    ("%y", "24"), ("Thang %m", "Thang 02"), ("%Y-%m-%d %H:%M:%S", "2024-02-05 03:04:09"), ("%-d/%-m", "5/2"),
    ("%b %B %a %A", "Feb February Mon Monday"), ("%j|%u|%w|%%", "036|1|1|%"), ("it's yyyy %f", "it's yyyy 000000")])
def test_strftime_in_both_orders(spark, fmt, want):
    session = adhoc.sql_session(spark, lambda s: Tables(*(s.range(1) for _ in range(3))))
    t = "TIMESTAMP_NTZ'2024-02-05 03:04:09'"
    got = adhoc.run_sql(session, f"SELECT strftime({t}, :f) AS a, strftime(:f, {t}) AS b", {"f": fmt}).first()
    assert tuple(got) == (want, want)


def test_strftime_dates_nulls_and_unknown_codes(spark):
    session = adhoc.sql_session(spark, lambda s: Tables(*(s.range(1) for _ in range(3))))
    got = adhoc.run_sql(session, "SELECT strftime('%Y-%m', DATE'2024-02-05') AS a, strftime(CAST(NULL AS DATE), '%Y') AS b").first()
    assert tuple(got) == ("2024-02", None)
    for bad in ("%Q", "%"):
        with pytest.raises(Exception, match="unknown code"):
            adhoc.run_sql(session, "SELECT strftime(:f, DATE'2024-02-05') AS a", {"f": "x" + bad}).collect()


def test_quantities_keep_their_type_and_floating_ids_are_refused(spark):
    from sellerlens.sources.files import ORDERS_TYPES, conform
    cols = ", ".join(f"`{k}` {'double' if k == N.QUANTITY else 'string'}" for k in N.ORDER_COLUMNS)
    row = tuple(1.5 if k == N.QUANTITY else "1" for k in N.ORDER_COLUMNS)
    df = conform(spark.createDataFrame([row], cols), ORDERS_TYPES)
    assert rows(df, N.QUANTITY) == [(1.5,)]
    bad = spark.createDataFrame([row], cols).withColumn(N.ORDER_ID, N.c(N.QUANTITY))
    with pytest.raises(ValueError, match="floating"):
        conform(bad, ORDERS_TYPES)
