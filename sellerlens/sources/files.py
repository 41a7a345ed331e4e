"""Table sources (SRC-1 … SRC-5).

Inputs are read from any Hadoop-compatible path (a file, a directory of
part files, or a partitioned dataset), never through the driver. Headers
are matched after stripping, required columns are checked before any job
runs, and types are cast to the declared ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sellerlens import names as N

# Declared input types. IDs are read as text (never as floating point).
# ``NumericType`` keeps whatever numeric type the file has (text becomes DOUBLE).
ORDERS_TYPES: dict[str, T.DataType] = {
    **{c: T.StringType() for c in N.ORDER_COLUMNS},
    N.QUANTITY: T.NumericType(),
}
INCOME_TYPES: dict[str, T.DataType] = {
    N.ADJUSTMENT_ID: T.StringType(),
    N.RELATED_ORDER_ID: T.StringType(),
    N.TYPE: T.StringType(),
    N.TOTAL_REVENUE: T.DoubleType(),
    N.TOTAL_FEES: T.DoubleType(),
    N.SETTLEMENT: T.DoubleType(),
    N.SETTLED_TIME: T.StringType(),
}
OVERVIEW_TYPES: dict[str, T.DataType] = {
    N.DAY: T.StringType(),
    N.PAGE_VIEWS: T.NumericType(),
    N.STORE_VISITS: T.NumericType(),
    N.CONVERSION: T.DoubleType(),
}

# Default file names below a base folder; any name can be passed instead.
DEFAULT_FILES = {"orders": "orders.parquet", "income": "income.parquet",
                 "overview": "overview.parquet"}


def strip_headers(df: DataFrame) -> DataFrame:
    """CL-1: strip every column name (Python ``str.strip``)."""
    return df.toDF(*[c.strip() for c in df.columns])


IDS = (N.ORDER_ID, N.SKU_ID, N.ADJUSTMENT_ID, N.RELATED_ORDER_ID)


def refuse_floating_ids(df: DataFrame, ids=IDS) -> None:
    """Raise for ID columns of a floating-point type: their digits are lost."""
    bad = [f.name for f in df.schema if f.name in ids and isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if bad:
        raise ValueError(f"IDs of floating-point type: {bad}")


def _cast(have: T.DataType, want: T.DataType) -> T.DataType | None:
    """Type to cast to, None to keep the column."""
    if type(want) is T.NumericType:
        return None if isinstance(have, T.NumericType) else T.DoubleType()
    return None if have == want else want


def conform(df: DataFrame, types: dict[str, T.DataType], strip: bool = True,
            keep_extra: bool = True) -> DataFrame:
    """Strip headers, check the required columns, cast them to ``types``.

    Raises ``ValueError`` naming every missing column, before any job runs.
    """
    if strip:
        df = strip_headers(df)
    missing = [c for c in types if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    refuse_floating_ids(df)
    wanted = {k: _cast(df.schema[k].dataType, t) for k, t in types.items()}
    casts = {k: N.c(k).cast(t) for k, t in wanted.items() if t is not None}
    df = df.withColumns(casts) if casts else df
    return df if keep_extra else df.select(*[N.c(k) for k in types])


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               **options) -> DataFrame | None:
    """SRC-1: read one table; ``None`` when the path does not exist."""
    try:
        return spark.read.format(fmt).options(**options).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or "") or "Path does not exist" in str(e):
            return None
        raise


def read_json_table(spark: SparkSession, path: str,
                    schema: T.StructType | str | None = None,
                    multi_line: bool = True) -> DataFrame | None:
    """SRC-2: JSON records as rows; ``None`` when the path does not exist.

    ``multi_line=True`` reads each file as one JSON document, a top-level
    array giving one row per element (the user-list format); such a file
    is one task, so many files read in parallel. ``multi_line=False`` reads
    JSON lines, which split into many tasks per file.
    """
    try:
        r = spark.read.option("multiLine", multi_line).option("encoding", "UTF-8")
        if schema is not None:
            r = r.schema(schema)
        return r.json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or "") or "Path does not exist" in str(e):
            return None
        raise


@dataclass(frozen=True)
class Tables:
    """Cleaned orders, classified income and the daily overview.

    ``entries`` optionally keeps the conformed, unclassified settlement
    entries, so a search for one order can classify just that order's
    entries (labels depend only on entries of the same related ID).
    """
    orders: DataFrame
    income: DataFrame
    overview: DataFrame
    entries: DataFrame | None = None

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> "Tables":
        """SRC-5: keep the three tables for reuse; lost blocks are recomputed."""
        return Tables(self.orders.persist(level), self.income.persist(level),
                      self.overview.persist(level), self.entries)

    def unpersist(self) -> None:
        for df in (self.orders, self.income, self.overview):
            df.unpersist()

    def register(self, spark: SparkSession | None = None) -> None:
        """SRC-4: expose as temp views ``orders``, ``income``, ``overview``.

        Views live in the tables' session; use :func:`sellerlens.operators.adhoc.sql_session`
        for an isolated session with these names.
        """
        self.orders.createOrReplaceTempView("orders")
        self.income.createOrReplaceTempView("income")
        self.overview.createOrReplaceTempView("overview")


def read_raw(spark: SparkSession, orders: str, income: str, overview: str,
             fmt: str = "parquet") -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Read the three raw tables, all or nothing (None if any is missing)."""
    dfs = tuple(read_table(spark, p, fmt) for p in (orders, income, overview))
    if any(d is None for d in dfs):
        return None
    return dfs  # type: ignore[return-value]


def load_tables(spark: SparkSession, orders: str, income: str, overview: str,
                fmt: str = "parquet") -> Tables | None:
    """SRC-3: read, conform, clean orders and classify income.

    Nothing runs yet: the result is three lazy DataFrames. ``None`` when a
    table is missing, as the reference returns nothing then.
    """
    from sellerlens.operators.cleaning import clean_orders
    from sellerlens.operators.income import classify_income

    raw = read_raw(spark, orders, income, overview, fmt)
    if raw is None:
        return None
    o, i, v = raw
    entries = conform(i, INCOME_TYPES)
    return Tables(
        clean_orders(conform(o, ORDERS_TYPES)),
        classify_income(entries),
        conform(v, OVERVIEW_TYPES, strip=False),
        entries,
    )


def load_folder(spark: SparkSession, base: str, files: dict[str, str] | None = None,
                fmt: str = "parquet") -> Tables | None:
    """``load_tables`` on ``base/<file>`` for the three default file names."""
    f = {**DEFAULT_FILES, **(files or {})}
    b = base.rstrip("/")
    return load_tables(spark, f"{b}/{f['orders']}", f"{b}/{f['income']}",
                       f"{b}/{f['overview']}", fmt)


def row_counts(tables: Tables) -> DataFrame:
    """The load report: number of order lines and of settlement entries.

    Two global counts, each a partial count per task plus one tiny merge.
    """
    o = tables.orders.agg(F.count(F.lit(1)).alias("orders_rows"))
    i = tables.income.agg(F.count(F.lit(1)).alias("income_rows"))
    return o.select("orders_rows", i.select("income_rows").scalar().alias("income_rows"))
