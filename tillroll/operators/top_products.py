"""Top products for new against returning brand customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillroll.functions.filters import valid_line
from tillroll.functions.windows import Window
from tillroll.sources.customers import CustomerFacts, per_customer

MEASURES = ["product_id", "product_title", "category", "customers", "orders", "total_units", "revenue"]


def product_measures(tx: DataFrame | CustomerFacts, pred) -> DataFrame:
    """Customers, orders, units and revenue per (product, category) of the
    lines ``pred`` selects (with a customer).

    Lines are summed per (product, order) and those per (product, customer)
    first, so distinct counts are plain counts and no line is multiplied; on
    the customer layout both steps run without a shuffle.  An order has one
    customer.
    """

    def of_customers(lines: DataFrame) -> DataFrame:
        per_order = lines.filter(pred).groupBy("product_id", "category", "customer_id", "order_id").agg(
            F.sum("units").alias("units"), F.sum("gross_revenue").alias("revenue")
        )
        return per_order.groupBy("product_id", "category", "customer_id").agg(
            F.count("order_id").alias("orders"), F.sum("units").alias("units"), F.sum("revenue").alias("revenue")
        )

    return (
        per_customer(tx, of_customers)
        .groupBy("product_id", "category")
        .agg(
            F.count("customer_id").alias("customers"),
            F.sum("orders").alias("orders"),
            F.sum("units").cast("bigint").alias("total_units"),
            F.sum("revenue").cast("double").alias("revenue"),
        )
    )


def top_products(
    tx: DataFrame | CustomerFacts,
    products: DataFrame,
    window: Window,
    brand_id: int,
    category: str | None,
    is_new: bool,
    *,
    k: int = 10,
    business_unit: str | None = "CORE",
    excluded_countries=("US", "Australia"),
    rank_col: str = "rank",
) -> DataFrame:
    """The k products with most units among lines of new (first purchase of
    the brand) or returning customers (B42).

    Aggregate per product first, then take the top k with a distributed
    top-k (TakeOrderedAndProject), then rank those k rows.  RANK of a row in
    the top k only depends on rows with more units, which are all in the top
    k, so ranks equal a global RANK without a single-partition sort of all
    products.  Ties at the cut are broken by product_id.
    ``tx`` must carry ``is_new_brand``; ``products`` is keyed by product_id.
    """
    pred = valid_line(
        window,
        excluded_countries=excluded_countries,
        business_unit=business_unit,
        brand_ids=[brand_id],
        category=category,
        customer_not_null=True,
    ) & (F.col("is_new_brand") == F.lit(is_new))
    per_product = product_measures(tx, pred).join(products.select("product_id", "product_title"), "product_id")
    top = per_product.orderBy(F.desc("total_units"), F.asc("product_id")).limit(k)
    ranked = top.withColumn(rank_col, F.rank().over(W.orderBy(F.desc("total_units"))).cast("bigint"))
    return ranked.select(rank_col, *MEASURES)


def face_off(new: DataFrame, returning: DataFrame) -> DataFrame:
    """Side by side on product_id (full outer join of two k-row frames)."""
    n = new.select(
        "rank_ntb", *[F.col(c).alias(f"ntb_{c}") for c in MEASURES]
    ).withColumnRenamed("ntb_total_units", "ntb_units")
    r = returning.select(
        "rank_rtb", *[F.col(c).alias(f"rtb_{c}") for c in MEASURES]
    ).withColumnRenamed("rtb_total_units", "rtb_units")
    j = n.join(r, n.ntb_product_id == r.rtb_product_id, "full")
    side = lambda p: [f"{p}_product_id", f"{p}_product_title", f"{p}_category", f"{p}_customers", f"{p}_units", f"{p}_revenue"]
    return j.select(
        "rank_ntb",
        (F.col("rank_ntb") - F.col("rank_rtb")).alias("rank_diff_ntb_vs_rtb"),
        *side("ntb"),
        "rank_rtb",
        (F.col("rank_rtb") - F.col("rank_ntb")).alias("rank_diff_rtb_vs_ntb"),
        *side("rtb"),
    ).orderBy(F.asc_nulls_last("rank_ntb"))


def top_products_new_vs_returning(tx, products, window, brand_id, category, **opts) -> DataFrame:
    new = top_products(tx, products, window, brand_id, category, True, rank_col="rank_ntb", **opts)
    ret = top_products(tx, products, window, brand_id, category, False, rank_col="rank_rtb", **opts)
    return face_off(new, ret)
