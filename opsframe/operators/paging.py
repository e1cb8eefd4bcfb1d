"""Order, limit, offset, pages, top-k and nth rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.plans.ordered import number_rows
from opsframe.plans.predicates import order_columns


def ordered(df: DataFrame, order, key: str | None = None) -> DataFrame:
    """Order by `col` / `-col` / `col desc`; the key is appended to make the order total."""
    by = order_columns(df, order)
    return df.orderBy(*by, *([F.col(key)] if key else []))


def slice_rows(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit in a total order given as `col` / `-col`.

    A distributed top-k, which keeps offset + limit rows per task. A caller who pages deep asks for `deep_slice`.
    """
    return df.orderBy(*order_columns(df, order)).offset(offset).limit(limit)


def deep_slice(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Number the rows over range partitions and keep those of the slice; rows that tie are each counted once."""
    numbered = number_rows(df, order_columns(df, order), "_at")
    return numbered.filter((F.col("_at") >= offset) & (F.col("_at") < offset + limit)).orderBy("_at").drop("_at")


def page_number(text) -> int:
    """Digits give that page; anything else is page 1."""
    text = str(text) if text is not None else ""
    return int(text) if text.isascii() and text.isdigit() else 1


def page_size(requested, maximum: int) -> int:
    """At most the maximum; the maximum when the request is not a number."""
    try:
        return min(int(requested), maximum)
    except (TypeError, ValueError):
        return maximum


def page(df: DataFrame, order, key: str, page_text=None, requested=None, maximum: int = 20) -> DataFrame:
    """One page. Page 0 is page 1; a page past the end is empty."""
    size = page_size(requested, maximum)
    asked = [o for o in ([order] if isinstance(order, str) else order) if o.lstrip("-") in df.columns]
    by = asked if key in [o.lstrip("-") for o in asked] else [*asked, key]
    return slice_rows(df, by, max(page_number(page_text) - 1, 0) * size, size)


def page_info(df: DataFrame, model: str, page_text=None, requested=None, maximum: int = 20) -> DataFrame:
    """One row: model, page, previous, next, pages, rows; previous and next are null at the ends."""
    size, now = page_size(requested, maximum), F.lit(page_number(page_text))
    pages = F.ceil(F.col("rows") / size)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(model).alias("model"), now.cast("long").alias("page"),
        F.when(now > 1, now - 1).cast("long").alias("previous"),
        F.when(now < pages, now + 1).cast("long").alias("next"),
        pages.cast("long").alias("pages"), "rows")


def top(df: DataFrame, order, k: int = 20, key: str | None = None) -> DataFrame:
    return ordered(df, order, key).limit(k)


def nth_row(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return slice_rows(df, order, n, 1)


def item(array: Column, n: int, default=None) -> Column:
    """n-th element (from 0) or the default."""
    return F.coalesce(F.get(array, F.lit(n)), F.lit(default)) if n >= 0 else F.lit(default)
