"""customer__nation__n_name=..&o_totalprice__gt=..&ordering=-o_totalprice&page=1 as nested rows."""

from __future__ import annotations

from dataclasses import replace

from opsframe.catalog.base import Shop
from opsframe.operators.joins import embed
from opsframe.operators.paging import ordered, page
from opsframe.plans.predicates import lookup_filter


def order_page(spark, sf, nation: str = "NATION_7", above: int = 100000, page_text: str = "1"):
    """Filter over the foreign keys, cut the page, then nest: only the page's rows are joined again.

    The filter leaves no null keys, so nesting can join inner, and Spark broadcasts the few rows of the
    page instead of moving the related tables.
    """
    orders = Shop(spark, sf).orders
    found = lookup_filter(orders, {"customer__nation__n_name": nation, "o_totalprice__gt": str(above)})
    rows = page(found, "-o_totalprice", "o_orderkey", page_text)
    nested = embed(replace(orders, frame=rows), ["customer__nation"], how="inner")
    return ordered(nested, "-o_totalprice", "o_orderkey")
