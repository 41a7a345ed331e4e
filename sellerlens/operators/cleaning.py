"""Order cleaning (CL-1 … CL-10): one narrow projection, no shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from sellerlens import names as N
from sellerlens.functions import text as T
from sellerlens.sources.files import strip_headers

clean_headers = strip_headers  # CL-1


def clean_text_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """CL-2 on each of ``columns``: text, no tab/CR/LF, stripped."""
    return df.withColumns({col: T.clean_text(N.c(col)) for col in columns})


def clean_order_text(df: DataFrame) -> DataFrame:
    """CL-3: CL-2 on the order ID and the six time columns."""
    return clean_text_columns(df, N.ORDER_TEXT_COLUMNS)


def normalize_places(df: DataFrame, provinces: Mapping[str, str] | None = None,
                     country_aliases: Sequence[str] | None = None) -> DataFrame:
    """CL-4, CL-5, CL-6: province prefixes + dictionary, country aliases."""
    country = (T.country_norm(N.c(N.COUNTRY)) if country_aliases is None
               else T.country_norm(N.c(N.COUNTRY), country_aliases))
    return df.withColumns({
        N.PROVINCE: T.province_norm(N.c(N.PROVINCE), provinces),
        N.COUNTRY: country,
    })


def add_sku_category(df: DataFrame, rules=None) -> DataFrame:
    """CL-7: ``SKU Category`` from ``Seller SKU`` through the ordered rules."""
    return df.withColumn(N.SKU_CATEGORY, T.sku_category(N.c(N.SELLER_SKU), rules))


def add_created_time(df: DataFrame) -> DataFrame:
    """CL-8, CL-9: ``Created_Timestamp`` (NTZ) and ``Order_Month`` (yyyy-MM)."""
    df = T.with_created_ts(df, N.CREATED_TIME, N.CREATED_TS)
    return df.withColumn(N.ORDER_MONTH, T.month_key(N.c(N.CREATED_TS)))


def clean_orders(df: DataFrame, provinces: Mapping[str, str] | None = None,
                 sku_rules=None) -> DataFrame:
    """CL-10: the whole order cleaning, in the original order of steps.

    Row-wise only: it plans as projections inside one codegen stage, so it
    also works unchanged on a streaming DataFrame.
    """
    return (df.transform(clean_headers)
              .transform(clean_order_text)
              .transform(normalize_places, provinces)
              .transform(add_sku_category, sku_rules)
              .transform(add_created_time))
