"""Scalar text, date and money expressions (CL-2, CL-4, CL-5, CL-8, CL-9, IN-12).

Everything here returns a ``Column`` built from Spark built-ins, so it runs
inside whole-stage codegen with no Python in the row path and no
dependency on the session time zone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sellerlens import names as N
from sellerlens.functions import mapping as M

# FIXED VALUES: the characters Python's ``str.isspace()`` accepts (and so
# ``str.strip()`` removes): \t \n \v \f \r, the four information separators
# U+001C-U+001F, space, U+0085, U+00A0, U+1680, U+2000-U+200A, U+2028,
# U+2029, U+202F, U+205F, U+3000. Written for Java regex; the same text is
# valid RE2 (DuckDB).
PY_SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# The same set as characters, for ``btrim`` (no regex needed).
PY_SPACE_CHARS = "".join(chr(i) for i in [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
# Control characters deleted anywhere in a cleaned text field.
TAB_CR_LF = "\t\r\n"

# FIXED VALUES: field patterns of the day-first timestamp ``%d/%m/%Y %H:%M:%S``
# and of the settle date ``%Y/%m/%d`` as the pandas parser accepts them
# (1- or 2-digit fields, 4-digit year, day may be " 1".." 9", seconds up to 61).
_DAY = r"(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])"
_MONTH = r"(1[0-2]|0[1-9]|[1-9])"
_YEAR = r"([0-9]{4})"
_HOUR = r"(2[0-3]|[01][0-9]|[0-9])"
_MINUTE = r"([0-5][0-9]|[0-9])"
_SECOND = r"(6[01]|[0-5][0-9]|[0-9])"
CREATED_PATTERN = rf"\A{_DAY}/{_MONTH}/{_YEAR}{PY_SPACE}+{_HOUR}:{_MINUTE}:{_SECOND}\z"
SETTLED_PATTERN = rf"\A{_YEAR}/{_MONTH}/{_DAY}\z"
# FIXED VALUES: the range of a nanosecond pandas timestamp; parsed values
# outside it become null there, so they do here.
TS_MIN = "1677-09-21 00:12:43.145224"
TS_MAX = "2262-04-11 23:47:16.854775"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace.

    ``F.trim`` alone is not equal: it removes only U+0020. ``btrim`` with the
    full character set is, and needs no regex.
    """
    return F.btrim(_col(c), F.lit(PY_SPACE_CHARS))


def clean_text(c: Column | str, null_as: str | None = None) -> Column:
    """CL-2: text cast, delete every tab/CR/LF anywhere, then strip.

    Null stays null; ``null_as`` gives the text to put instead (the pandas
    original produced "None" or "nan").
    """
    out = py_strip(F.translate(_col(c).cast("string"), TAB_CR_LF, ""))
    return out if null_as is None else F.coalesce(out, F.lit(null_as))


def strip_prefix(c: Column | str, prefixes: Sequence[str]) -> Column:
    """Remove one leading occurrence of the first of ``prefixes`` that the
    text starts with (case-sensitive), like ``^(a|b)`` replaced by nothing."""
    c = _col(c)
    out = c
    for p in reversed(prefixes):
        out = F.when(c.startswith(p), F.substring(c, F.lit(len(p) + 1), F.length(c))).otherwise(out)
    return out


def province_prefix(c: Column | str) -> Column:
    """CL-4: drop ``Tỉnh ``/``Tinh ``, then ``Thanh pho ``/``Thành phố ``/
    ``Thành Phố ``, then strip. A leading space blocks both prefixes."""
    c = strip_prefix(c, M.PROVINCE_PREFIX_PASS_1)
    c = strip_prefix(c, M.PROVINCE_PREFIX_PASS_2)
    return py_strip(c)


def province_norm(c: Column | str, mapping=None) -> Column:
    """CL-4 then CL-6: prefix removal, strip, dictionary (one lookup)."""
    return M.replace_values(province_prefix(c), M.PROVINCE_MAP if mapping is None else mapping)


def country_norm(c: Column | str, aliases: Sequence[str] = tuple(M.COUNTRY_ALIASES),
                 target: str = M.COUNTRY_TARGET) -> Column:
    """CL-5: exact alias spellings become ``target``; others and null kept."""
    c = _col(c)
    return F.when(c.isin(list(aliases)), F.lit(target)).otherwise(c)


def sku_category(c: Column | str, rules=None) -> Column:
    """CL-7: the ordered SKU rules, compiled to one map lookup."""
    return M.rewrite_rules(_col(c), M.SKU_RULES if rules is None else rules)


def _field(c: Column, pattern: str, group: int) -> Column:
    """Group ``group`` of ``pattern`` as int; null when ``c`` does not match.

    ``regexp_extract`` compiles its literal pattern once per task (``split``
    with a multi-character pattern would compile it on every row)."""
    return F.trim(F.regexp_extract(c, pattern, group)).try_cast("int")


def _in_pandas_range(ts: Column, year: Column) -> Column:
    """``ts`` if a pandas nanosecond timestamp can hold it, else null. The
    exact bound is only evaluated in the two boundary years."""
    lo = F.lit(TS_MIN).cast("timestamp_ntz")
    hi = F.lit(TS_MAX).cast("timestamp_ntz")
    ok = (F.when((year > 1677) & (year < 2262), F.lit(True))
           .when(year == 1677, ts >= lo)
           .when(year == 2262, ts <= hi)
           .otherwise(F.lit(False)))
    return F.when(ok, ts)


def created_ts(c: Column | str) -> Column:
    """CL-8: parse day-first ``d/m/Y H:M:S`` into TIMESTAMP_NTZ, bad -> null.

    Fields may have 1 or 2 digits, the year exactly 4; any run of Unicode
    whitespace separates date and time; seconds 60 and 61 roll into the next
    minute; impossible dates are null. Independent of the session time zone.
    """
    c = _col(c)
    f = lambda i: _field(c, CREATED_PATTERN, i)
    year = f(3)
    base = F.try_make_timestamp_ntz(years=year, months=f(2), days=f(1),
                                    hours=f(4), mins=f(5), secs=F.lit(0))
    return _in_pandas_range(base + F.make_dt_interval(secs=f(6)), year)


def settled_date(c: Column | str) -> Column:
    """IN-12: parse ``Y/m/d`` into DATE, bad -> null (no surrounding spaces)."""
    c = _col(c)
    f = lambda i: _field(c, SETTLED_PATTERN, i)
    year = f(1)
    ts = F.try_make_timestamp_ntz(years=year, months=f(2), days=f(3),
                                  hours=F.lit(0), mins=F.lit(0), secs=F.lit(0))
    return _in_pandas_range(ts, year).cast("date")


def _with_parsed(df: DataFrame, src: str, out: str, pattern: str,
                 order: tuple[int, ...], has_time: bool) -> DataFrame:
    """Parse ``src`` into TIMESTAMP_NTZ column ``out`` in three projections.

    Column expressions cannot bind local values, so the Column versions
    above repeat the field extraction wherever a field is used. Here the
    digit fields are extracted once into a helper array and the timestamp
    built once into a helper column; Spark keeps such non-trivial helper
    projections separate, so each is evaluated once per row, and the
    generated code stays small enough for the JIT.
    """
    c = N.c(src)
    digits = F.when(c.rlike(pattern), F.regexp_extract_all(c, F.lit("[0-9]+"), 0))
    df = df.withColumn("__fields", digits)
    g = lambda i: F.get(F.col("__fields"), order[i]).cast("int")
    if has_time:
        ts = (F.try_make_timestamp_ntz(years=g(0), months=g(1), days=g(2), hours=g(3),
                                       mins=g(4), secs=F.lit(0))
              + F.make_dt_interval(secs=g(5)))
    else:
        ts = F.try_make_timestamp_ntz(years=g(0), months=g(1), days=g(2), hours=F.lit(0),
                                      mins=F.lit(0), secs=F.lit(0))
    df = df.withColumn("__ts", ts)
    lo = F.lit(TS_MIN).cast("timestamp_ntz")
    hi = F.lit(TS_MAX).cast("timestamp_ntz")
    t = F.col("__ts")
    return df.withColumn(out, F.when((t >= lo) & (t <= hi), t)).drop("__fields", "__ts")


def with_created_ts(df: DataFrame, src: str = N.CREATED_TIME, out: str = N.CREATED_TS) -> DataFrame:
    """CL-8 as a DataFrame step (same result as ``created_ts``, cheaper)."""
    return _with_parsed(df, src, out, CREATED_PATTERN, (2, 1, 0, 3, 4, 5), has_time=True)


def with_settled_date(df: DataFrame, src: str = N.SETTLED_TIME, out: str = N.SETTLED_TIME) -> DataFrame:
    """IN-12 as a DataFrame step (same result as ``settled_date``, cheaper)."""
    df = _with_parsed(df, src, "__settled", SETTLED_PATTERN, (0, 1, 2), has_time=False)
    return df.withColumn(out, F.col("__settled").cast("date")).drop("__settled") if out != "__settled" else df


def month_key(c: Column | str) -> Column:
    """CL-9: ``yyyy-MM`` text of a timestamp or date (sorts in time order)."""
    return F.date_format(_col(c), "yyyy-MM")


def money_text(c: Column | str) -> Column:
    """``f"{x:,.0f} ₫"``: thousands commas, round half-even, null stays null."""
    c = _col(c)
    body = (F.when(F.isnan(c), F.lit("nan"))
             .when(c == F.lit(float("inf")), F.lit("inf"))
             .when(c == F.lit(float("-inf")), F.lit("-inf"))
             .otherwise(F.format_number(c, 0)))
    return F.concat(body, F.lit(N.CURRENCY_SUFFIX))


def starts_with_text(c: Column | str, prefix: str) -> Column:
    """Null-safe ``startswith`` on the text form (null -> False)."""
    return F.coalesce(_col(c).cast("string").startswith(prefix), F.lit(False))
