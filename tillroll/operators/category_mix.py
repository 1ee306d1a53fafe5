"""Category combinations per order (A5)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.filters import valid_line
from tillroll.functions.windows import Window
from tillroll.sources.customers import CustomerFacts, per_customer

# The five named categories, in the reference's order.
NAMED_CATEGORIES = ["Hair", "Cosmetics", "Skin", "Fragrance", "Body"]


def order_category_flags(
    tx: DataFrame | CustomerFacts,
    window: Window,
    brand_ids: Iterable[int],
    *,
    category_values: Mapping[str, str] | None = None,
    business_unit=None,
    excluded_countries: Iterable[str] = ("US", "Australia"),
) -> DataFrame:
    """One row per (customer, order): 0/1 flag per named category and Other,
    then the 17 combination flags (B22-B23).

    ``category_values`` maps each label to the category value in the data
    (identity by default).  A NULL category sets no flag.
    """
    values = {label: (category_values or {}).get(label, label) for label in NAMED_CATEGORIES}
    pred = valid_line(
        window,
        excluded_countries=excluded_countries,
        business_unit=business_unit,
        brand_ids=brand_ids,
        customer_not_null=True,
    )
    cat = F.col("category")
    line_flags = [F.when(cat == v, 1).otherwise(0).alias(label) for label, v in values.items()]
    line_flags.append(F.when(~cat.isin(*values.values()), 1).otherwise(0).alias("Other"))
    labels = [*NAMED_CATEGORIES, "Other"]
    flags = [F.max(c).alias(c) for c in labels]
    per_order = per_customer(
        tx, lambda lines: lines.filter(pred).select("customer_id", "order_id", *line_flags).groupBy("customer_id", "order_id").agg(*flags)
    )
    return per_order.select("customer_id", "order_id", *combination_flags(labels))


def _sum_of(cols: Iterable[str]) -> Column:
    out = F.lit(0)
    for c in cols:
        out = out + F.col(c)
    return out


def combination_flags(labels: list[str]) -> list[Column]:
    """Solo flags, duo flags over the named categories, and Other-with-any."""
    out = []
    for one in labels:
        rest = [c for c in labels if c != one]
        out.append(F.when((F.col(one) == 1) & (_sum_of(rest) == 0), 1).otherwise(0).alias(f"{one}_Only"))
    named = [c for c in labels if c != "Other"]
    for a, b in combinations(named, 2):
        rest = [c for c in labels if c not in (a, b)]
        cond = (F.col(a) == 1) & (F.col(b) == 1) & (_sum_of(rest) == 0)
        out.append(F.when(cond, 1).otherwise(0).alias(f"{a}_{b}"))
    out.append(
        F.when((F.col("Other") == 1) & (_sum_of(named) > 0), 1).otherwise(0).alias("Other_with_Category")
    )
    return out


def category_mix(
    tx: DataFrame | CustomerFacts,
    window: Window,
    brand_ids: Iterable[int],
    **options,
) -> DataFrame:
    """One row: distinct orders and the number of orders per combination."""
    flags = order_category_flags(tx, window, brand_ids, **options)
    measures = [c for c in flags.columns if c not in ("customer_id", "order_id")]
    return flags.agg(
        F.countDistinct("order_id").alias("Orders"),
        *[F.sum(c).cast("bigint").alias(c) for c in measures],
    )
