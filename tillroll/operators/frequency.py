"""Order-frequency distribution (A12) and buyer types by year."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillroll.functions.filters import valid_line
from tillroll.functions.windows import Window
from tillroll.sources.customers import CustomerFacts, lines_of, per_customer

EXCLUDED = ("US", "Australia")


def qualified_orders(
    tx: DataFrame | CustomerFacts,
    window: Window,
    brand_ids: Iterable[int],
    *,
    excluded_countries: Iterable[str] = EXCLUDED,
    site_id: int | None = 37,
) -> DataFrame:
    """Valid lines of the given brands with their order year."""
    pred = valid_line(
        window,
        excluded_countries=excluded_countries,
        site_id=site_id,
        revenue_positive=True,
        brand_ids=brand_ids,
    )
    return lines_of(tx).filter(pred).select(
        "business_unit", "site", "site_id", "region", "customer_id", "order_id", "order_sequence",
        F.year("order_date").cast("bigint").alias("order_year"), "order_date", "category",
        F.lit(1).alias("is_lux_order"),
    )


def order_frequency(
    tx: DataFrame | CustomerFacts,
    window: Window,
    brand_ids: Iterable[int],
    category: str,
    *,
    excluded_countries: Iterable[str] = EXCLUDED,
    site_id: int | None = 37,
) -> DataFrame:
    """Customers by number of distinct orders in the category: 1, 2, 3, 4+.

    Two aggregations: orders per customer (no shuffle on the customer layout;
    else (customer, order) pairs are combined map-side), then customers per
    bucket.  NULL customers form a bucket row that counts 0.
    """

    def orders(lines: DataFrame) -> DataFrame:
        found = qualified_orders(lines, window, brand_ids, excluded_countries=excluded_countries, site_id=site_id)
        return found.filter(F.col("category") == category).groupBy("customer_id").agg(F.countDistinct("order_id").alias("orders"))

    counts = per_customer(tx, orders)
    o = F.col("orders")
    bucket = (
        F.when(o == 1, "1 order").when(o == 2, "2 orders").when(o == 3, "3 orders").otherwise("4 or more orders")
    )
    sort_key = F.when(o == 1, 1).when(o == 2, 2).when(o == 3, 3).otherwise(4)
    return (
        counts.groupBy(bucket.alias("order_frequency"), sort_key.alias("sort_order"))
        .agg(F.count("customer_id").alias("num_customers"))
        .orderBy("sort_order")
        .select("order_frequency", "num_customers")
    )


def customer_year_orders(
    tx: DataFrame | CustomerFacts,
    window: Window,
    brand_ids: Iterable[int],
    category: str,
    *,
    excluded_countries: Iterable[str] = EXCLUDED,
    site_id: int | None = 37,
) -> DataFrame:
    """Distinct orders per (customer, year)."""
    pred = valid_line(
        window,
        excluded_countries=excluded_countries,
        site_id=site_id,
        revenue_positive=True,
        brand_ids=brand_ids,
        category=category,
    )
    year = F.year("order_date").cast("bigint").alias("order_year")
    return per_customer(
        tx, lambda lines: lines.filter(pred).groupBy("customer_id", year).agg(F.countDistinct("order_id").alias("orders_per_year"))
    )


def customer_types_by_year(
    tx: DataFrame | CustomerFacts,
    window: Window,
    brand_ids: Iterable[int],
    category: str,
    *,
    excluded_countries: Iterable[str] = EXCLUDED,
    site_id: int | None = 37,
) -> DataFrame:
    """one_time / consistent_once / other buyers per year.

    one_time: one order in the whole window; consistent_once: several years,
    exactly one order in each; other: the rest.  A customer has a row per
    year (the window's years at most), so its years are looked at together:
    one scan, and a window over a handful of rows.
    """
    options = dict(excluded_countries=excluded_countries, site_id=site_id)
    of_customer = W.partitionBy("customer_id")

    def summary(lines: DataFrame) -> DataFrame:
        per_year = customer_year_orders(lines, window, brand_ids, category, **options)
        return per_year.select(
            "customer_id",
            "order_year",
            F.sum("orders_per_year").over(of_customer).alias("total_orders"),
            F.count("order_year").over(of_customer).alias("years_bought"),
            F.count_if(F.col("orders_per_year") == 1).over(of_customer).alias("years_with_exactly_one"),
        )

    buyer_type = (
        F.when(F.col("total_orders") == 1, "one_time")
        .when(
            (F.col("years_bought") > 1) & (F.col("years_bought") == F.col("years_with_exactly_one")),
            "consistent_once",
        )
        .otherwise("other")
    )
    joined = per_customer(tx, summary).where("customer_id is not null").withColumn("buyer_type", buyer_type)

    def n(label: str):
        return F.sum(F.when(F.col("buyer_type") == label, 1).otherwise(0)).cast("bigint")

    return (
        joined.groupBy("order_year")
        .agg(
            n("one_time").alias("one_time_buyers"),
            n("consistent_once").alias("consistent_once_buyers"),
            n("other").alias("other_buyers"),
            F.count("customer_id").alias("total_customers"),  # a row per customer and year
        )
        .orderBy("order_year")
    )
