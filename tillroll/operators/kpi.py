"""Monthly category/brand KPIs: this year, last year, last year aligned.

The reference loops over months and, per month, scans the fact table with
three date ranges.  Here the months become rows of a small *period calendar*
(date -> month, TY/LY/LY_AL flags), derived from the calendar table and the
``as_of`` parameters; it is joined to the facts on the date key, so one scan
serves all months.  A date can serve two months (1 Dec can be LY-aligned for
November and LY for December): the join duplicates such lines on purpose.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions import windows as win
from tillroll.sources.customers import CustomerFacts, per_customer
from tillroll.sources.partitioned import replace_partitions

# Dimension columns and KPI names of the monthly table.
DIMS = [
    "business_unit", "country_group", "region", "site", "brand_submarket", "category", "subcategory",
    "brand_name", "brand_category", "warehouse_name", "external_reporting_flag", "is_gwp",
    "us_category", "us_subcategory", "partnership_flag",
]
SUM_KPIS = [
    "rrp_revenue", "list_revenue", "gross_revenue", "net_revenue", "shipping_revenue",
    "gp", "cogs", "funding", "discount", "units",
]
KPIS = ["orders", *SUM_KPIS, "total_customers", "new_to_category_customers"]
PERIODS = [("ty", "TY"), ("ly", "LY"), ("ly_al", "LY_AL")]


def period_calendar(spark: SparkSession, calendar: DataFrame, as_of) -> DataFrame:
    """date_key, order_date, calendar_year_month, period_ty/ly/ly_al.

    The month list comes from ``as_of`` (two months); aligned bounds are looked
    up in ``calendar`` (full_date -> last_year_day_aligned) by one global
    aggregate, a row that is broadcast to the calendar's days.  The result has
    at most 2 months x 3 periods x 31 days rows, whatever the data size.
    """
    yesterday = win.as_date(as_of) - dt.timedelta(days=1)
    months = win.kpi_months(as_of)
    # one row: the aligned day of each month's first and last day
    aligned = calendar.agg(
        *[
            F.max(F.when(F.col("full_date") == F.lit(day), F.col("last_year_day_aligned"))).alias(f"{name}_{i}")
            for i, m in enumerate(months)
            for name, day in (("al_start", m.start), ("al_end", m.end))
        ]
    )
    d = F.col("full_date")
    of_month = []
    for i, m in enumerate(months):
        start, end = F.lit(m.start), F.lit(m.end)
        in_ly = d.between(F.add_months(start, -12), F.add_months(end, -12))
        in_al = d.between(F.col(f"al_start_{i}"), F.col(f"al_end_{i}"))
        of_month.append(
            F.struct(
                F.lit(m.start.strftime("%Y%m")).alias("calendar_year_month"),
                # TY is tested against yesterday, as in the reference.
                F.when(d.between(start, F.lit(yesterday)), "TY").alias("period_ty"),
                F.when(in_ly, "LY").alias("period_ly"),
                F.when(in_al, "LY_AL").alias("period_ly_al"),
                (d.between(start, end) | in_ly | F.coalesce(in_al, F.lit(False))).alias("_in_range"),
            )
        )
    # Every date of the three ranges carries at least one period (the
    # reference's WHERE), and no period reaches past yesterday.  The second,
    # single-column predicate also lets Spark treat the calendar as a
    # selective side and prune fact partitions dynamically.
    in_a_period = F.col("period_ty").isin("TY") | F.col("period_ly").isin("LY") | F.col("period_ly_al").isin("LY_AL")
    tagged = calendar.filter(d <= F.lit(yesterday)).crossJoin(F.broadcast(aligned)).select(
        F.col("full_date").alias("order_date"), "date_key", F.explode(F.array(*of_month)).alias("p")
    )
    return (
        tagged.select("order_date", "p.*", "date_key", (F.year("order_date") * 100 + F.month("order_date")).cast("int").alias("order_month"))
        .filter(F.col("_in_range") & in_a_period)
        .drop("_in_range")
    )


def kpi_preaggregate(daily_base: DataFrame | CustomerFacts, periods: DataFrame, brand_attr: DataFrame, dims: list[str]) -> DataFrame:
    """Sums and distinct counts per (period flags, month, dims).

    The period calendar is bounded by the parameters (under 200 rows), so it
    is broadcast.  The join also matches the month key, the partition column
    of the fact table, so dynamic partition pruning reads only the months the
    calendar holds.

    Three grouped sums instead of distinct counts on raw lines: an order's
    lines, a customer's orders, then the customers (an order has one customer),
    so no line is multiplied.  On the customer layout the first two run inside
    the customers' buckets; only the last, combined map-side to a row per
    period, dims and task, crosses the network.
    """
    keys = ["period_ty", "period_ly", "period_ly_al", "calendar_year_month", *dims]
    sums = [F.sum(k).alias(k) for k in SUM_KPIS]
    by_date = F.broadcast(periods.drop("order_date"))

    def of_customers(lines: DataFrame) -> DataFrame:
        f = lines.join(by_date, ["date_key", "order_month"]).join(brand_attr, "brand_id", "left")
        per_order = f.groupBy(*keys, "customer_id", "order_id").agg(*sums, F.max("new_category").alias("new_category"))
        return per_order.groupBy(*keys, "customer_id").agg(
            F.count("order_id").alias("orders"), *sums, F.max("new_category").alias("new_category")
        )

    return per_customer(daily_base, of_customers).groupBy(*keys).agg(
        F.sum("orders").alias("orders"),
        *sums,
        F.count("customer_id").alias("total_customers"),
        F.count(F.when(F.col("new_category") == 1, F.col("customer_id"))).alias("new_to_category_customers"),
    )


def kpi_pivot(pre: DataFrame, dims: list[str]) -> DataFrame:
    """13 KPIs x {ty, ly, ly_al} by conditional sums, 0 when absent.

    Counts are summed over period-flag combinations, so a customer seen in
    both LY-only and LY+aligned days counts twice (kept from the reference).
    """
    cols = []
    for k in KPIS:
        for suffix, label in PERIODS:
            s = F.sum(F.when(F.col(f"period_{suffix}") == label, F.col(k)))
            if k in ("orders", "units", "total_customers", "new_to_category_customers"):
                cols.append(F.coalesce(s, F.lit(0)).cast("bigint").alias(f"{k}_{suffix}"))
            else:
                cols.append(F.coalesce(s.cast("double"), F.lit(0.0)).alias(f"{k}_{suffix}"))
    return pre.groupBy("calendar_year_month", *dims).agg(*cols)


def monthly_kpi(
    spark: SparkSession,
    daily_base: DataFrame | CustomerFacts,
    calendar: DataFrame,
    brand_attr: DataFrame,
    as_of,
    dims: list[str] = DIMS,
) -> DataFrame:
    periods = period_calendar(spark, calendar, as_of)
    return kpi_pivot(kpi_preaggregate(daily_base, periods, brand_attr, dims), dims)


def reload_monthly_kpi(
    spark: SparkSession,
    daily_base: DataFrame | CustomerFacts,
    calendar: DataFrame,
    brand_attr: DataFrame,
    as_of,
    table: str,
    location: str,
    dims: list[str] = DIMS,
    replace: Callable = replace_partitions,
) -> None:
    """Replace the months of this run in the monthly table (B47); ``replace``
    as in ``pricing.refresh_daily_prices``."""
    rows = monthly_kpi(spark, daily_base, calendar, brand_attr, as_of, dims)
    months = [m.start.strftime("%Y%m") for m in win.kpi_months(as_of)]
    replace(spark, rows, table, location, "calendar_year_month", months)
