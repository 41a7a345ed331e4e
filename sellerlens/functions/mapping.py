"""Dictionaries used by order cleaning, and how they become Spark expressions.

All lookups compile to a literal ``map`` in the expression itself: no join,
no broadcast, nothing collected, one codegen stage. A user-supplied
dictionary that is too large for a literal can be passed as a DataFrame to
:func:`lookup_join` instead.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the marketplace's own spellings; do not edit).
# ---------------------------------------------------------------------------

# Country spellings that mean Vietnam.
COUNTRY_ALIASES = [
    "Viêt Nam",
    "Vietnam",
    "The Socialist Republic of Viet Nam",
    "Socialist Republic of Vietnam",
]
COUNTRY_TARGET = "Việt Nam"

# Province prefixes removed before the dictionary lookup (two passes, in order).
PROVINCE_PREFIX_PASS_1 = ["Tỉnh ", "Tinh "]
PROVINCE_PREFIX_PASS_2 = ["Thanh pho ", "Thành phố ", "Thành Phố "]

# Province spellings -> canonical name. Two targets look like typos
# (" Bình Thuận" with a leading space, "hải Phòng"); they are kept as the
# source has them.
PROVINCE_MAP = {
    "Ba Ria– Vung Tau": "Bà Rịa - Vũng Tàu",
    "Bà Rịa-Vũng Tàu": "Bà Rịa - Vũng Tàu",
    "Ba Ria - Vung Tau": "Bà Rịa - Vũng Tàu",
    "Bac Giang": "Bắc Giang",
    "Bac Lieu": "Bạc Liêu",
    "Bac Ninh": "Bắc Ninh",
    "Ben Tre": "Bến Tre",
    "Binh Dinh": "Bình Định",
    "Binh Duong": "Bình Dương",
    "Binh Duong Province": "Bình Dương",
    "Binh Phuoc": "Bình Phước",
    "Binh Thuan": "Bình Thuận",
    "Ca Mau": "Cà Mau",
    "Ca Mau Province": "Cà Mau",
    "Can Tho": "Cần Thơ",
    "Phố Cần Thơ": "Cần Thơ",
    "Da Nang": "Đà Nẵng",
    "Da Nang City": "Đà Nẵng",
    "Phố Đà Nẵng": "Đà Nẵng",
    "Dak Lak": "Đắk Lắk",
    "Đắc Lắk": "Đắk Lắk",
    "Ðắk Nông": "Đắk Nông",
    "Đắk Nông": "Đắk Nông",
    "Dak Nong": "Đắk Nông",
    "Dong Nai": "Đồng Nai",
    "Dong Nai Province": "Đồng Nai",
    "Dong Thap": "Đồng Tháp",
    "Dong Thap Province": "Đồng Tháp",
    "Ha Nam": "Hà Nam",
    "Ha Noi": "Hà Nội",
    "Ha Noi City": "Hà Nội",
    "Phố Hà Nội": "Hà Nội",
    "Hai Phong": "Hải Phòng",
    "Phố Hải Phòng": "Hải Phòng",
    "Ha Tinh": "Hà Tĩnh",
    "Hau Giang": "Hậu Giang",
    "Hô-Chi-Minh-Ville": "Hồ Chí Minh",
    "Ho Chi Minh": "Hồ Chí Minh",
    "Ho Chi Minh City": "Hồ Chí Minh",
    "Kota Ho Chi Minh": "Hồ Chí Minh",
    "Hoa Binh": "Hòa Bình",
    "Hoà Bình": "Hòa Bình",
    "Hung Yen": "Hưng Yên",
    "Khanh Hoa": "Khánh Hòa",
    "Khanh Hoa Province": "Khánh Hòa",
    "Khánh Hoà": "Khánh Hòa",
    "Kien Giang": "Kiên Giang",
    "Kiến Giang": "Kiên Giang",
    "Long An Province": "Long An",
    "Nam Dinh": "Nam Định",
    "Nghe An": "Nghệ An",
    "Ninh Binh": "Ninh Bình",
    "Ninh Thuan": "Ninh Thuận",
    "Quang Binh": "Quảng Bình",
    "Quang Tri": "Quảng Trị",
    "Quang Nam": "Quảng Nam",
    "Quang Ngai": "Quảng Ngãi",
    "Quang Ninh": "Quảng Ninh",
    "Quang Ninh Province": "Quảng Ninh",
    "Soc Trang": "Sóc Trăng",
    "Tay Ninh": "Tây Ninh",
    "Thai Binh": "Thái Bình",
    "Thanh Hoa": "Thanh Hóa",
    "Thanh Hoá": "Thanh Hóa",
    "Hai Duong": "Hải Dương",
    "Thừa Thiên Huế": "Thừa Thiên-Huế",
    "Thua Thien Hue": "Thừa Thiên-Huế",
    "Vinh Long": "Vĩnh Long",
    "Tra Vinh": "Trà Vinh",
    "Vinh Phuc": "Vĩnh Phúc",
    "Cao Bang": "Cao Bằng",
    "Lai Chau": "Lai Châu",
    "Ha Giang": "Hà Giang",
    "Lam Dong": "Lâm Đồng",
    "Lao Cai": "Lào Cai",
    "Phu Tho": "Phú Thọ",
    "Phu Yen": "Phú Yên",
    "Thai Nguyen": "Thái Nguyên",
    "Son La": "Sơn La",
    "Tuyen Quang": "Tuyên Quang",
    "Yen Bai": "Yên Bái",
    "Dien Bien": "Điện Biên",
    "Tien Giang": "Tiền Giang",
    "Kien Giang Province": "Kiên Giang",
    "Soc Trang Province": "Sóc Trăng",
    "Bac Lieu Province": "Bạc Liêu",
    "Binh Thuan Province": " Bình Thuận",
    "Thai Binh Province": "Thái Bình",
    "Ninh Thuan Province": "Ninh Thuận",
    "An Giang Province": "An Giang",
    "Province de Nam Dinh": "Nam Định",
    "Thanh Hoa Province": "Thanh Hóa",
    "Phu Yen Province": "Phú Yên",
    "Tay Ninh Province": "Tây Ninh",
    "Hai Phong City": "hải Phòng",
    "Provinz Dak Lak": "Đắk Lắk",
    "Ba Ria – Vung Tau Province": "Bà Rịa - Vũng Tàu",
    "Province de Hau Giang": "Hậu Giang",
    "Provinz Binh Thuan": "Bình Thuận",
    "Tien Giang Province": "Tiền Giang",
    "Lang Son": "Lạng Sơn",
    "Can Tho City": "Cần Thơ",
    "Bac Kan": "Bắc Kạn",
}

# Seller SKU -> SKU category: anchored rules applied in this order.
SKU_RULES = [
    (r"^(COMBO-SC-ANHDUC|COMBO-SC-NGOCTRINH|COMBO-SC-MIX|SC_COMBO_MIX|SC_COMBO_MIX_LIVESTREAM|COMBO-SC_LIVESTREAM|SC_COMBO_MIX_01)$", "COMBO-SC"),
    (r"^SC_X1$", "SC-450g"),
    (r"^SC_X2$", "SC-x2-450g"),
    (r"^(SC_COMBO_X1|COMBO-CAYVUA-X1|SC_COMBO_X1_LIVESTREAM|COMBO-SCX1|COMBO-SCX1_LIVESTREAM)$", "COMBO-SCX1"),
    (r"^(SC_COMBO_X2|COMBO-SIEUCAY-X2|SC_COMBO_X2_LIVESTREAM|COMBO-SCX2|COMBO-SCX2_LIVESTREAM)$", "COMBO-SCX2"),
    (r"^(BTHP-Cay-200gr|BTHP_Cay)$", "BTHP-CAY"),
    (r"^(BTHP-200gr|BTHP_KhongCay)$", "BTHP-0CAY"),
    (r"^(BTHP_COMBO_MIX|BTHP003_combo_mix)$", "BTHP-COMBO"),
    (r"^(BTHP_COMBO_KhongCay|BTHP003_combo_kocay)$", "BTHP-COMBO-0CAY"),
    (r"^(BTHP_COMBO_Cay|BTHP003_combo_cay)$", "BTHP-COMBO-CAY"),
    (r"^BTHP-COMBO\+SC_X1$", "COMBO_BTHP_SCx1"),
    (r"^BTHP-COMBO\+SC_X2$", "COMBO_BTHP_SCx2"),
    (r"^BTHP_COMBO_MIX\+SC_X1$", "COMBO_BTHP_SCx1"),
    (r"^BTHP_COMBO_MIX\+SC_X2$", "COMBO_BTHP_SCx2"),
    (r"^(BTHP-2Cay-2KhongCay)$", "COMBO_4BTHP"),
    (r"^(BTHP-4Hu-KhongCay)$", "4BTHP_0CAY"),
    (r"^(BTHP-4Hu-Cay)$", "4BTHP_CAY"),
]

# ---------------------------------------------------------------------------
# Expressions
# ---------------------------------------------------------------------------


def map_literal(mapping: Mapping[str, str]) -> Column:
    """A ``map<string,string>`` literal; evaluated once per task, not per row."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def replace_values(col: Column, mapping: Mapping[str, str]) -> Column:
    """Exact whole-value replacement, all keys at once (not chained).

    Values without an entry, and nulls, pass through unchanged.
    """
    if not mapping:
        return col
    return F.coalesce(F.try_element_at(map_literal(mapping), col), col)


_LITERAL_CHAR = r"(?:[^()|\\^$.*?+{}\[\]]|\\[+.*?()\[\]{}|^$\\-])"
# ``^(lit|lit|...)$`` or ``^lit$``; a bare ``^a|b$`` is not a full match.
_LITERAL_ALTERNATION = re.compile(
    rf"^\^(?:\(({_LITERAL_CHAR}+(?:\|{_LITERAL_CHAR}+)*)\)|({_LITERAL_CHAR}+))\$$")


def rules_to_lookup(rules: Sequence[tuple[str, str]]) -> dict[str, str] | None:
    """Turn ``[(regex, replacement)]`` into one exact-match dictionary if that
    is equivalent to applying the rules one after the other.

    It is when every rule is an anchored alternation of plain literals, the
    replacement has no group reference, and no replacement is matched by a
    later rule (no cascades). Returns None otherwise.
    """
    lookup: dict[str, str] = {}
    for i, (pattern, repl) in enumerate(rules):
        m = _LITERAL_ALTERNATION.match(pattern)
        if m is None or "\\" in repl or "$" in repl:
            return None
        for alt in (m.group(1) or m.group(2)).split("|"):
            key = re.sub(r"\\(.)", r"\1", alt)
            lookup.setdefault(key, repl)  # first rule wins, as in sequence
        for later_pattern, _ in rules[i + 1:]:
            if re.fullmatch(later_pattern.strip("^$"), repl):
                return None
    return lookup


def rewrite_rules(col: Column, rules: Sequence[tuple[str, str]],
                  compile_lookup: bool = True) -> Column:
    """Apply regex rules in order, like a chain of ``str.replace(regex=True)``.

    Anchored literal rules collapse into one map lookup. The ``$`` anchor of
    those rules also matches before one final ``\\n`` (Python regex
    semantics), which is kept in the output. Other rule sets fall back to a
    fold of ``regexp_replace`` (Java regex), still a built-in expression.
    """
    lookup = rules_to_lookup(rules) if compile_lookup else None
    if lookup is None:
        out = col
        for pattern, repl in rules:
            if "(?P" in pattern:
                raise ValueError(f"named groups are not supported: {pattern!r}")
            out = F.regexp_replace(out, _java_pattern(pattern), _java_replacement(repl))
        return out
    trailing_nl = col.endswith(F.lit("\n"))
    key = F.when(trailing_nl, F.regexp_replace(col, r"\n\z", "")).otherwise(col)
    hit = F.try_element_at(map_literal(lookup), key)
    # concat is null when there is no hit, so unmatched values fall through
    return F.coalesce(F.concat(hit, F.when(trailing_nl, F.lit("\n")).otherwise(F.lit(""))), col)


def _java_pattern(pattern: str) -> str:
    r"""Python regex -> Java regex for the one anchor that differs: Python's
    ``$`` matches at the end or before one final ``\n`` only; Java's also
    before ``\r``, ``\r\n``, U+0085, U+2028, U+2029. An unescaped ``$``
    outside a character class becomes ``(?=\n?\z)``."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            out.append(pattern[i:i + 2])
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "$":
            ch = r"(?=\n?\z)"
        out.append(ch)
        i += 1
    return "".join(out)


def _java_replacement(repl: str) -> str:
    """Python replacement text -> Java replacement text (``\\1`` and
    ``\\g<1>`` -> ``$1``). Named groups and other escapes are refused."""
    out = []
    for m in re.finditer(r"\\g<(\d+)>|\\([1-9]\d?)|\\(\\)|(\\.?)|([^\\]+)", repl):
        number = m.group(1) or m.group(2)
        if m.group(4) is not None:
            raise ValueError(f"replacement {repl!r} is not supported: {m.group(4)!r}")
        if number is not None:
            # Java reads on digits after $n, so a following digit is cut off by an escape
            out.append(f"${int(number)}")
        elif m.group(3):
            out.append(r"\\")
        else:
            text = m.group(5).replace("$", r"\$")
            out.append("\\" + text if out and out[-1].startswith("$") and text[0].isdigit() else text)
    return "".join(out)


def lookup_join(df: DataFrame, col: str, dictionary: DataFrame,
                key: str = "key", value: str = "value") -> DataFrame:
    """Replace values of ``col`` through a dictionary held as a DataFrame.

    For dictionaries too big for a literal map. Keys must be unique (a
    repeated key would repeat rows). Spark picks broadcast or sort-merge by
    the dictionary's measured size (AQE); unmatched and null values keep
    their text.
    """
    d = dictionary.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    return (df.join(d, F.col(col) == F.col("__k"), "left")
              .withColumn(col, F.coalesce(F.col("__v"), F.col(col)))
              .drop("__k", "__v"))
