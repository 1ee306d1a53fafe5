"""Products bought together with a set of target brands."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillroll.functions.filters import valid_line
from tillroll.functions.windows import Window
from tillroll.plans.written import written

BASKET = ["business_unit", "order_number"]


def basket_lines(tx: DataFrame, window: Window, target_brands: Iterable[int]) -> DataFrame:
    """Distinct (unit, order, brand name, product) of valid lines, and whether
    the product is of a target brand (B25, B26).

    Deduplicating first caps a huge basket at one row per distinct product.
    """
    lines = tx.filter(valid_line(window, not_gift=False) & ~F.col("is_gwp"))
    target = F.max(F.col("brand_key").isin(list(target_brands)))
    return lines.groupBy(*BASKET, "brand_name", "product_id").agg(target.alias("is_target"))


def _pair_counts(tx: DataFrame, window: Window, target_brands: Iterable[int]) -> DataFrame:
    """Orders with each (target product, other product) pair, without titles.

    The basket is written once and read as both inputs of the pair join, so
    both are plain scans and Spark can split a large order on either side
    (plans.written).  A product occurs once in an order, so counting rows
    counts orders, combined map-side: pairs cross the network once.
    """
    basket = written(basket_lines(tx, window, target_brands), "basket")
    return _counted(_pairs(_targets(basket), _others(basket)))


PAIR = ["business_unit", "target_brand", "target_product_id", "co_brand", "co_product_id"]


def _targets(basket: DataFrame, *columns: str) -> DataFrame:
    return basket.filter("is_target").select(*BASKET, F.col("brand_name").alias("target_brand"), F.col("product_id").alias("target_product_id"), *columns)


def _others(basket: DataFrame, *columns: str) -> DataFrame:
    return basket.select(*BASKET, F.col("brand_name").alias("co_brand"), F.col("product_id").alias("co_product_id"), *columns)


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """A row per order and pair of different products in it."""
    return a.join(b, BASKET).filter(F.col("target_product_id") != F.col("co_product_id"))


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("orders_together"))


def _with_titles(pairs: DataFrame, products: DataFrame) -> DataFrame:
    title = lambda side: products.select(
        F.col("product_id").alias(f"{side}_product_id"), F.col("product_title").alias(f"{side}_product_title")
    )
    return pairs.join(title("target"), "target_product_id").join(title("co"), "co_product_id")


def basket_pairs(tx: DataFrame, products: DataFrame, window: Window, target_brands: Iterable[int]) -> DataFrame:
    """Distinct orders holding each (target product, other product) pair.
    ``products`` has a row per product_id."""
    return _with_titles(_pair_counts(tx, window, target_brands), products).select(
        "business_unit", "target_brand", "target_product_id", "target_product_title", "co_brand", "co_product_id", "co_product_title", "orders_together"
    )


def basket_cross_sell(
    tx: DataFrame,
    products: DataFrame,
    window: Window,
    target_brands: Iterable[int],
    k: int = 3,
    per_business_unit: bool = False,
) -> DataFrame:
    """Top-k co-purchased products per target product (ROW_NUMBER <= k).

    By default the ranking spans all business units of a product, as in the
    original report (rows still carry their unit); ``per_business_unit``
    ranks within each unit instead.  Ties are broken by unit, brands and
    product ids so the cut is deterministic.  The filter on the row number
    lets Spark keep only k rows per product in each task before the shuffle
    (WindowGroupLimit); titles join the k rows.
    """
    top = _ranked(_pair_counts(tx, window, target_brands), per_business_unit).filter(F.col("rank") <= k)
    return _report(top, products)


def _ranked(pairs: DataFrame, per_business_unit: bool) -> DataFrame:
    part = ["business_unit", "target_product_id"] if per_business_unit else ["target_product_id"]
    w = W.partitionBy(*part).orderBy(F.desc("orders_together"), "business_unit", "target_brand", "co_brand", "co_product_id")
    return pairs.withColumn("rank", F.row_number().over(w).cast("bigint"))


def _report(top: DataFrame, products: DataFrame) -> DataFrame:
    return _with_titles(top, products).select(
        "business_unit", "target_brand", "target_product_id", "target_product_title", "co_brand", "co_product_id", "co_product_title", "orders_together", "rank"
    ).orderBy("business_unit", "target_product_id", F.desc("orders_together"))


def bounded_pairs(basket: DataFrame, k: int, heavy: int, per_business_unit: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs (a row per order) that can be among the first k of their target:
    those with the ``heavy`` most sold products, and the rest within the bound.

    A pair occurs in at most as many orders as its other product.  The pairs
    with heavy products are counted first; the k-th of a target is a floor for
    its first k pairs, so another product with fewer orders than the floor
    cannot be among them, and its pairs are not formed.
    """
    part = ["business_unit", "target_product_id"] if per_business_unit else ["target_product_id"]
    sold = written(basket.groupBy("business_unit", "brand_name", "product_id").agg(F.count(F.lit(1)).alias("orders")), "products-sold")
    first = sold.orderBy(F.desc("orders"), "business_unit", "brand_name", "product_id").limit(heavy).withColumn("heavy", F.lit(True))
    marked = sold.join(F.broadcast(first.drop("orders")), ["business_unit", "brand_name", "product_id"], "left")  # ``heavy`` rows
    marked = written(basket.join(marked, ["business_unit", "brand_name", "product_id"]), "basket-with-orders")
    seed = _pairs(_targets(marked), _others(marked.filter("heavy")))
    floors = _ranked(_counted(seed), per_business_unit).filter(F.col("rank") == k).select(*part, F.col("orders_together").alias("floor"))
    light = _others(marked.filter("heavy is null"), "orders")
    targets = _targets(marked).join(written(floors, "pair-floors"), part, "left")
    return seed, _pairs(targets, light).filter(F.col("orders") >= F.coalesce("floor", F.lit(0))).drop("orders", "floor")


def basket_cross_sell_bounded(
    tx: DataFrame,
    products: DataFrame,
    window: Window,
    target_brands: Iterable[int],
    k: int = 3,
    per_business_unit: bool = False,
    heavy: int = 512,
) -> DataFrame:
    """``basket_cross_sell`` with pairs left out that cannot reach the first k
    (``bounded_pairs``).  Pays where few products make most orders: then the
    floors are high and most other products lie below them."""
    basket = written(basket_lines(tx, window, target_brands), "basket")
    seed, rest = bounded_pairs(basket, k, heavy, per_business_unit)
    pairs = _counted(seed).unionByName(_counted(rest))
    return _report(_ranked(pairs, per_business_unit).filter(F.col("rank") <= k), products)
