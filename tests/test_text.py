"""Rule tests for the scalar cleaning expressions (FIXTURES.md §2).

Expected values are typed by hand from the stated semantics.
"""

import datetime as dt
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sellerlens.functions import mapping as M
from sellerlens.functions import text as T


def apply(spark, fn, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"s {typ}")
    return [r[0] for r in df.select(fn(F.col("s"))).collect()]


def test_whitespace_set_is_python_isspace():
    expected = "".join(chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace())
    assert T.PY_SPACE_CHARS == expected


def test_clean_text(spark):
    got = apply(spark, T.clean_text, ["a\tb\n ", "\xa0x\xa0", "　z", "\x1fq\x1f", None, " a b ", "a\r\nb"])
    assert got == ["ab", "x", "z", "q", None, "a b", "ab"]


def test_province(spark):
    cases = {
        "Tỉnh Bắc Giang": "Bắc Giang",
        "Tỉnh Thành phố X": "X",
        " Tỉnh Y": "Tỉnh Y",
        "tỉnh Z": "tỉnh Z",
        "Ho Chi Minh City": "Hồ Chí Minh",
        "Tinh Long An Province": "Long An",
        "Thành Phố Cần Thơ": "Cần Thơ",
        "Binh Thuan Province": " Bình Thuận",
        "Hai Phong City": "hải Phòng",
        "Nowhere": "Nowhere",
        "Thành phố Tỉnh Q": "Tỉnh Q",
        "Ðắk Nông": "Đắk Nông",
    }
    got = apply(spark, T.province_norm, list(cases) + [None])
    assert got == list(cases.values()) + [None]


def test_province_dictionary_size():
    assert len(M.PROVINCE_MAP) == 103
    assert len(set(M.PROVINCE_MAP.values())) == 63


def test_country(spark):
    vals = ["Viêt Nam", "Vietnam", "The Socialist Republic of Viet Nam",
            "Socialist Republic of Vietnam", "vietnam", "Thailand", None]
    assert apply(spark, T.country_norm, vals) == ["Việt Nam"] * 4 + ["vietnam", "Thailand", None]


def test_sku_category(spark):
    vals = ["SC_X1", "SC_COMBO_X2_LIVESTREAM", "COMBO-SCX1", "BTHP-COMBO+SC_X1",
            "BTHP_COMBO_MIX+SC_X1", "sc_x1", "SC_X10", None, "SC_X1\n", "BTHP-4Hu-Cay"]
    want = ["SC-450g", "COMBO-SCX2", "COMBO-SCX1", "COMBO_BTHP_SCx1", "COMBO_BTHP_SCx1",
            "sc_x1", "SC_X10", None, "SC-450g\n", "4BTHP_CAY"]
    assert apply(spark, T.sku_category, vals) == want


def test_sku_rules_compile_to_lookup():
    lookup = M.rules_to_lookup(M.SKU_RULES)
    assert lookup is not None and len(lookup) == 36
    # a cascading rule set cannot be a lookup
    assert M.rules_to_lookup([(r"^a$", "b"), (r"^b$", "c")]) is None
    # a non-literal rule cannot either
    assert M.rules_to_lookup([(r"^a+$", "b")]) is None
    assert M.rules_to_lookup([(r"^ab|cd$", "x")]) is None
    assert M.rules_to_lookup([(r"^a\+b$", "x")]) == {"a+b": "x"}


def test_rewrite_rules_fold_equals_lookup(spark):
    vals = ["SC_X1", "COMBO-SC-MIX", "BTHP_Cay", "UNMAPPED", None, "BTHP003_combo_cay"]
    fold = lambda c: M.rewrite_rules(c, M.SKU_RULES, compile_lookup=False)
    assert apply(spark, fold, vals) == apply(spark, T.sku_category, vals)


def test_rewrite_rules_general_regex(spark):
    rules = [(r"^(\w+)-(\d)$", r"\2:\1"), (r"x", "y")]
    assert apply(spark, lambda c: M.rewrite_rules(c, rules), ["ab-3", "xx", None]) == ["3:ab", "yy", None]


def test_created_timestamp(spark):
    ok = dt.datetime(2024, 2, 1, 3, 4, 5)
    vals = ["01/02/2024 03:04:05", "1/2/2024 3:4:5", "01/02/2024  03:04:05",
            "01/02/2024\xa003:04:05", "31/02/2024 00:00:00", "01/02/24 00:00:00",
            "01/02/2024", "01/02/2024 24:00:00", "01/02/2024 03:04:05 x", "N/A",
            "01/02/2024 03:04:60", "31/12/2024 23:59:61", "01/02/1500 00:00:00", None]
    want = [ok, ok, ok, ok, None, None, None, None, None, None,
            dt.datetime(2024, 2, 1, 3, 5, 0), dt.datetime(2025, 1, 1, 0, 0, 1), None, None]
    assert apply(spark, T.created_ts, vals) == want
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    assert [r[0] for r in T.with_created_ts(df, "s", "t").select("t").collect()] == want


def test_created_timestamp_ignores_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        got = apply(spark, T.created_ts, ["10/03/2024 02:30:00"])
        assert got == [dt.datetime(2024, 3, 10, 2, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_settled_date(spark):
    d = dt.date(2024, 1, 5)
    vals = ["2024/01/05", "2024/1/5", "2024-01-05", "2024/02/30", "2024/01/05 10:00", "/", "2024/1/ 5", None]
    want = [d, d, None, None, None, None, d, None]
    assert apply(spark, T.settled_date, vals) == want
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    assert [r[0] for r in T.with_settled_date(df, "s", "s").select("s").collect()] == want


def test_month_key(spark):
    assert apply(spark, T.month_key, [dt.datetime(2024, 2, 1, 3, 4, 5), None], "timestamp_ntz") == ["2024-02", None]


def test_money_text(spark):
    vals = [1234567.5, 0.5, -1234.5, None, 2.5, float("nan")]
    assert apply(spark, T.money_text, vals, "double") == [
        "1,234,568 ₫", "0 ₫", "-1,234 ₫", None, "2 ₫", "nan ₫"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab \t\n\r\xa0　Tỉnh")), max_size=8), max_size=6))
def test_clean_text_matches_python(spark, values):
    got = apply(spark, T.clean_text, values)
    want = [v.replace("\t", "").replace("\r", "").replace("\n", "").strip() for v in values]
    assert got == want
    # cleaning twice equals cleaning once
    assert apply(spark, T.clean_text, got) == got


def test_fold_end_anchor_follows_python(spark):
    fold = lambda c: M.rewrite_rules(c, M.SKU_RULES, compile_lookup=False)
    vals = ["SC_X1\n", "SC_X1\r", "SC_X1\r\n", "SC_X1 "]
    # Python's $ matches only before one final \n
    assert apply(spark, fold, vals) == ["SC-450g\n", "SC_X1\r", "SC_X1\r\n", "SC_X1 "]
    assert apply(spark, fold, vals) == apply(spark, T.sku_category, vals)


def test_null_as_and_general_rules(spark):
    from sellerlens.functions import mapping as MM
    from sellerlens.functions import text as TT
    df = spark.createDataFrame([(None,), (" a\t",)], "x string")
    assert [r[0] for r in df.select(TT.clean_text("x", null_as="None")).collect()] == ["None", "a"]
    one = spark.createDataFrame([("ab12",)], "x string")
    rules = [(r"^([a-z])([a-z])(\d+)$", r"\g<2>\g<1>0-\3$"), (r"^ba0", r"\\")]
    assert one.select(MM.rewrite_rules(F.col("x"), rules)).first()[0] == "\\-12$"
    for bad in ([(r"(?P<n>a)", "x")], [("a", r"\g<n>")], [("a", r"\q")]):
        with pytest.raises(ValueError):
            one.select(MM.rewrite_rules(F.col("x"), bad))


def test_dictionary_counts_and_samples():
    """Typed by hand, independent of the oracle's use of the same module."""
    from sellerlens.functions import mapping as MM
    assert len(MM.PROVINCE_MAP) == 103 and len(MM.SKU_RULES) == 17
    assert MM.PROVINCE_MAP["Lang Son"] == "Lạng Sơn" and MM.PROVINCE_MAP["Can Tho City"] == "Cần Thơ"
    assert MM.PROVINCE_MAP["Provinz Dak Lak"] == "Đắk Lắk" and MM.COUNTRY_TARGET == "Việt Nam"
    assert MM.rules_to_lookup(MM.SKU_RULES)["SC_X1"] == "SC-450g"
