"""Ad hoc SQL over the three tables (AH-1).

``sql_session`` returns a separate session (same cluster, own temp views
and settings) in which ``orders``, ``income`` and ``overview`` are views
of the cleaned tables, so user SQL cannot clash with the caller's views.
The dialect bridge is configuration only: double-quoted identifiers
(``"Order ID"``) and a ``strftime`` SQL function that takes time and format
in either order; codes it does not know raise an error. Parameters go through ``args`` (bound
literals), never through string formatting.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sellerlens.sources.files import Tables

# FIXED VALUES: strftime codes and the Spark expression for each, over ``t``.
STRFTIME_CODES = {
    "%Y": "date_format(t, 'yyyy')", "%y": "date_format(t, 'yy')", "%m": "date_format(t, 'MM')", "%-m": "date_format(t, 'M')",
    "%B": "date_format(t, 'MMMM')", "%b": "date_format(t, 'MMM')", "%d": "date_format(t, 'dd')", "%-d": "date_format(t, 'd')",
    "%A": "date_format(t, 'EEEE')", "%a": "date_format(t, 'EEE')", "%j": "date_format(t, 'DDD')", "%-j": "date_format(t, 'D')",
    "%w": "string(dayofweek(t) - 1)", "%u": "string(weekday(t) + 1)", "%H": "date_format(t, 'HH')", "%-H": "date_format(t, 'H')",
    "%I": "date_format(t, 'hh')", "%-I": "date_format(t, 'h')", "%p": "date_format(t, 'a')", "%M": "date_format(t, 'mm')",
    "%-M": "date_format(t, 'm')", "%S": "date_format(t, 'ss')", "%-S": "date_format(t, 's')", "%g": "date_format(t, 'SSS')",
    "%f": "date_format(t, 'SSSSSS')", "%x": "date_format(t, 'yyyy-MM-dd')", "%X": "date_format(t, 'HH:mm:ss')",
    "%c": "date_format(t, 'yyyy-MM-dd HH:mm:ss')", "%%": "'%'",
}


def _strftime_body() -> str:
    """``strftime(a, b)``: one argument is the format (the one holding a
    ``%``), the other the time. The format is cut into codes and literal
    text; unknown codes raise."""
    time = "CAST(CASE WHEN contains(a, '%') THEN b ELSE a END AS TIMESTAMP_NTZ)"
    fmt = "CASE WHEN contains(a, '%') THEN a ELSE b END"
    cases = " ".join(f"WHEN '{code}' THEN {expr.replace('(t', '(' + time)}" for code, expr in STRFTIME_CODES.items())
    part = (f"CASE p {cases} ELSE CASE WHEN startswith(p, '%') "
            "THEN raise_error(concat('strftime: unknown code ', p)) ELSE p END END")
    return (f"CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN array_join(transform("
            f"regexp_extract_all({fmt}, '%-?.?|[^%]+', 0), p -> {part}), '') END")


def sql_session(spark: SparkSession, build: Callable[[SparkSession], Tables]) -> SparkSession:
    """A new session with the three views; ``build(session)`` loads the tables
    in that session (e.g. ``lambda s: load_folder(s, base)``)."""
    s = spark.newSession()
    s.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    tables = build(s)
    tables.register()
    s.sql("CREATE OR REPLACE TEMPORARY FUNCTION strftime(a STRING, b STRING) "
          f"RETURNS STRING RETURN {_strftime_body()}")
    return s


def run_sql(session: SparkSession, text: str, args: dict[str, Any] | None = None) -> DataFrame:
    """Run one statement; errors surface as Spark's analysis/parse exceptions."""
    return session.sql(text, args=args)
