"""Histories of orders, ranks of products and prices at the time of sale.

The windows of the analyses (H1-H8) over keys of any size: running sums, LAG,
row numbers and ranks run over slices (``plans.segmented``), so neither a brand
with a third of all orders nor a rank over all products ends up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.filters import valid_line
from tillroll.functions.windows import Window
from tillroll.operators.top_products import product_measures
from tillroll.plans.intervals import interval_join
from tillroll.plans.segmented import Sliced
from tillroll.sources.customers import CustomerFacts, lines_of


def brand_order_history(tx: DataFrame | CustomerFacts, window: Window, *, excluded_countries=("US", "Australia")) -> DataFrame:
    """A row per (brand, order) with a sale: its position in the brand's
    history, the revenue up to and with it, and the order date before it."""
    pred = valid_line(window, excluded_countries=excluded_countries)
    orders = lines_of(tx).filter(pred).groupBy("brand_id", "order_id").agg(
        F.min("order_date").alias("order_date"), F.sum("gross_revenue").alias("revenue")
    )
    s = Sliced(orders, ["brand_id"], ["order_date", "order_id"])
    s = s.row_number("position").running_sum("running_revenue", "revenue").lag("prev_order_date", "order_date")
    return s.frame().select(
        "brand_id", "order_id", "order_date", "position", "prev_order_date",
        F.col("revenue").cast("double").alias("revenue"), F.col("running_revenue").cast("double").alias("running_revenue"),
    )


def product_ranks(tx: DataFrame | CustomerFacts, window: Window, *, is_new: bool | None = None, excluded_countries=("US", "Australia")) -> DataFrame:
    """Every product's measures and its RANK by units among all products
    (B42 without the cut); equal units share a rank."""
    pred = valid_line(window, excluded_countries=excluded_countries, customer_not_null=True)
    if is_new is not None:
        pred = pred & (F.col("is_new_brand") == F.lit(is_new))
    measures = product_measures(tx, pred)
    return Sliced(measures, [], ["-total_units"], ["product_id", "category"]).rank("rank").frame()


def prices_at_sale(
    tx: DataFrame | CustomerFacts, prices: DataFrame, window: Window, *, locale: int, currency: int, excluded_countries=("US", "Australia")
) -> DataFrame:
    """Units sold per (product, site, day) with the list price of the day, from
    ``prices`` (intervals [Valid_From, Valid_To) of the current and the
    historic list, one valid at a time); NULL where there is none (E5, E6)."""
    pred = valid_line(window, excluded_countries=excluded_countries)
    sold = lines_of(tx).filter(pred).groupBy("product_key", "site_id", "order_date").agg(F.sum("units").cast("bigint").alias("units"))
    offers = prices.filter((F.col("Locale_Key") == locale) & (F.col("Currency_Key") == currency)).select(
        F.col("Product_key").alias("product_key"), F.col("Site_Key").alias("site_id"), "Valid_From", "Valid_To", "RRP", "Price"
    )
    on = ["product_key", "site_id"]
    return interval_join(sold, offers, on, "order_date", "Valid_From", "Valid_To", "left", [*on, "order_date"])
