"""Three yearly cohorts, each followed for three years (A3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.filters import valid_line
from tillroll.functions.windows import Window
from tillroll.sources.customers import CustomerFacts, per_customer


def retention_cohorts(
    tx: DataFrame | CustomerFacts,
    brand_id: int,
    start_year: int,
    *,
    business_unit: str | None = "CORE",
    excluded_countries=("US", "Australia"),
    cohorts: int = 3,
    years: int = 3,
) -> DataFrame:
    """Rows ``'<year> Retention'`` with Year_1..Year_n: how many customers
    active in the cohort year were active again 0, 1, .. years later.

    One scan: each customer gets a bit mask of the years it bought in (a
    grouped BIT_OR, combined map-side, so a hot customer costs nothing extra),
    then one global aggregate counts mask patterns.  Every cohort row exists
    even when it is empty.
    """
    span = cohorts + years - 1
    window = Window(dt.date(start_year, 1, 1), dt.date(start_year + span - 1, 12, 31))
    kwargs = {} if business_unit is False else {"business_unit": business_unit}
    pred = valid_line(window, excluded_countries=excluded_countries, brand_ids=[brand_id], **kwargs)
    bit = F.expr(f"shiftleft(1L, year(order_date) - {int(start_year)})")
    masks = per_customer(
        tx, lambda lines: lines.filter(pred & F.col("customer_id").isNotNull()).groupBy("customer_id").agg(F.bit_or(bit).alias("m"))
    )

    def active(bit: int):
        return F.col("m").bitwiseAND(F.lit(1 << bit).cast("bigint")) != 0

    counts = []
    for c in range(cohorts):
        for k in range(years):
            both = active(c) & active(c + k)
            counts.append(F.sum(F.when(both, 1).otherwise(0)).cast("bigint").alias(f"c{c}_y{k}"))
    totals = masks.agg(*counts)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f"{start_year + c} Retention").alias("cohort"),
                    *[F.coalesce(F.col(f"c{c}_y{k}"), F.lit(0)).alias(f"Year_{k + 1}") for k in range(years)],
                )
                for c in range(cohorts)
            ]
        )
    ).alias("r")
    return totals.select(rows).select("r.*").orderBy("cohort")
