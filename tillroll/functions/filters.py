"""The shared "valid order line" predicate.

Every script in the reference repeats a variant of the same WHERE clause.  Each
option here is one of those conjuncts; a value of ``None`` leaves it out.  The
predicate is a single Column so Catalyst can push the simple parts of it down
to the parquet scan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.windows import Window

_UNSET = object()


def valid_line(
    window: Window | None = None,
    *,
    units_positive: bool = True,
    not_gift: bool = True,
    paid: bool = True,
    excluded_countries: Iterable[str] | None = None,
    business_unit=_UNSET,
    site_id: int | None = None,
    revenue_positive: bool = False,
    customer_not_null: bool = False,
    brand_ids: Iterable[int] | None = None,
    category: str | None = None,
) -> Column:
    """Build the valid-line predicate over the canonical transaction columns
    (which include ``order_month`` = yyyyMM of ``order_date``).

    ``business_unit``: a string keeps that unit; ``None`` keeps any non-NULL
    unit (the reference's ``business_unit = business_unit`` self-comparison);
    unset skips the test.
    """
    conds: list[Column] = []
    if window is not None:
        conds.append(F.col("order_date").between(F.lit(window.start), F.lit(window.end)))
        # Same window on the month key: a partition filter on the fact table.
        lo, hi = window.start.year * 100 + window.start.month, window.end.year * 100 + window.end.month
        conds.append(F.col("order_month").between(lo, hi))
    if units_positive:
        conds.append(F.col("units") > 0)
    if not_gift:
        conds.append(~F.col("is_gift"))
    if paid:
        conds.append(F.col("payment_status") == "Paid")
    if excluded_countries:
        conds.append(~F.col("country_group").isin(list(excluded_countries)))
    if business_unit is not _UNSET:
        if business_unit is None:
            conds.append(F.col("business_unit").isNotNull())
        else:
            conds.append(F.col("business_unit") == business_unit)
    if site_id is not None:
        conds.append(F.col("site_id") == site_id)
    if revenue_positive:
        conds.append(F.col("gross_revenue") > 0)
    if customer_not_null:
        conds.append(F.col("customer_id").isNotNull())
    if brand_ids is not None:
        conds.append(F.col("brand_id").isin(list(brand_ids)))
    if category is not None:
        conds.append(F.col("category") == category)
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def valid_lines(tx: DataFrame, window: Window | None = None, **options) -> DataFrame:
    return tx.filter(valid_line(window, **options))
