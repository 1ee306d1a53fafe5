"""Orders around a customer's first luxury order (A4)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillroll.functions.filters import valid_line
from tillroll.functions.windows import Window
from tillroll.plans.ranking import row_number_by
from tillroll.plans.written import written
from tillroll.sources.customers import CustomerFacts, per_customer

# Submarket groups and order-type labels.
MASS = ["Mass", "Masstige"]
PRESTIGE = "Prestige"
PRESTIGE_LUX = "Prestige-Lux"


def base_orders(
    tx: DataFrame | CustomerFacts, window: Window, *, site_id: int | None = 37, excluded_countries=("US", "Australia")
) -> DataFrame | CustomerFacts:
    """Valid lines with their order year (B14), in the layout of ``tx``."""
    pred = valid_line(window, excluded_countries=excluded_countries, site_id=site_id, revenue_positive=True)

    def lines(df: DataFrame) -> DataFrame:
        return df.filter(pred).select(
            "customer_id", "order_id", "order_date", "order_sequence", "brand_id", "category",
            F.year("order_date").cast("bigint").alias("order_year"),
        )

    return tx.map(lines) if isinstance(tx, CustomerFacts) else lines(tx)


def entry_event(base: DataFrame | CustomerFacts, brand_ids: Iterable[int], category: str) -> DataFrame:
    """Per customer: smallest sequence and earliest date of a luxury line.
    Both minima are taken independently, as in the reference."""
    luxury = F.col("brand_id").isin(list(brand_ids)) & (F.col("category") == category)
    minima = [F.min("order_sequence").alias("entry_sequence"), F.min("order_date").alias("entry_date")]
    return per_customer(base, lambda lines: lines.filter(luxury).groupBy("customer_id").agg(*minima))


def _rolled_up(lines: DataFrame) -> DataFrame:
    """A row per (customer, order)."""
    orders = lines.groupBy("customer_id", "order_id").agg(
        F.min("order_date").alias("order_date"),
        F.min("order_sequence").alias("order_sequence"),
        F.collect_set("brand_id").alias("brand_ids"),
    )
    return orders.withColumn("order_year", F.year("order_date").cast("bigint"))


ORDER = ["order_date", "order_sequence", "order_id"]
OFFSETS = ["customer_id", "order_id", "order_date", "order_sequence", "brand_ids", "order_year"]


def customer_order_offsets(base: DataFrame | CustomerFacts, brand_ids: Iterable[int], category: str) -> DataFrame:
    """Orders of entered customers with their position relative to the entry
    order (B16-B18).

    Customers of the regular layout hold a bounded number of lines: entry,
    numbering and offset are aggregates and windows over the customer, in one
    pass over the bucketed lines.  Hot customers, and frames without a layout,
    go through ``order_offsets``.
    """
    luxury = F.col("brand_id").isin(list(brand_ids)) & (F.col("category") == category)

    def whole(lines: DataFrame) -> DataFrame:
        of_customer = W.partitionBy("customer_id")
        marked = lines.withColumn("_luxury", luxury)
        orders = marked.groupBy("customer_id", "order_id").agg(
            F.min("order_date").alias("order_date"),
            F.min("order_sequence").alias("order_sequence"),
            F.collect_set("brand_id").alias("brand_ids"),
            F.min(F.when(F.col("_luxury"), F.col("order_sequence"))).alias("_sequence"),
            F.min(F.when(F.col("_luxury"), F.col("order_date"))).alias("_date"),
            F.max("_luxury").alias("_luxury"),
        )
        orders = orders.withColumns(
            {
                "entry_sequence": F.min("_sequence").over(of_customer),
                "entry_date": F.min("_date").over(of_customer),
                "entered": F.max("_luxury").over(of_customer),
                "rn": F.row_number().over(of_customer.orderBy(*ORDER)),
            }
        )
        is_entry = (F.col("order_date") == F.col("entry_date")) & (F.col("order_sequence") == F.col("entry_sequence"))
        orders = orders.withColumn("entry_rn", F.min(F.when(is_entry, F.col("rn"))).over(of_customer))
        return orders.filter("entered and customer_id is not null and entry_rn is not null").select(
            *OFFSETS[:-1], F.year("order_date").cast("bigint").alias("order_year"), (F.col("rn") - F.col("entry_rn")).cast("bigint").alias("order_from_lux")
        )

    return per_customer(base, whole, lambda lines: order_offsets(lines, entry_event(lines, brand_ids, category)))


def order_offsets(base: DataFrame, entry: DataFrame) -> DataFrame:
    """Orders of entered customers with their position relative to the entry
    order (B16-B18), by a plan that splits a hot customer.

    Orders are rolled up per (customer, order); the position in the customer's
    history is a skew-safe row number (a customer with a huge history is cut
    into range slices, not sent to one task).  The entry row is found with a
    join on (customer, date, sequence).
    """
    entry = written(entry, "luxury-entries")
    orders = _rolled_up(base.join(entry.select("customer_id"), "customer_id", "left_semi"))
    # The numbered orders keep their (small) columns, so the entry row and the
    # offsets both come from one numbering, without joining the roll-up back.
    numbered = row_number_by(orders, ["customer_id"], ORDER)
    entry_rows = (
        numbered.select("customer_id", "order_date", "order_sequence", "rn")
        .join(
            entry.withColumnRenamed("entry_date", "order_date").withColumnRenamed("entry_sequence", "order_sequence"),
            ["customer_id", "order_date", "order_sequence"],
        )
        .groupBy("customer_id")
        .agg(F.min("rn").alias("entry_rn"))
    )
    return numbered.join(written(entry_rows, "entry-rows"), "customer_id").select(
        *OFFSETS, (F.col("rn") - F.col("entry_rn")).alias("order_from_lux")
    )


def order_submarket_counts(orders: DataFrame, brand_meta: DataFrame) -> DataFrame:
    """Number of distinct brands per submarket group in each order.

    A brand without metadata (or with a NULL submarket) adds to no counter.
    ``brand_meta`` is a brand dimension, one row per brand.
    """
    exploded = orders.select(
        "customer_id", "order_id", "order_date", "order_sequence", "order_year", "order_from_lux",
        F.explode_outer("brand_ids").alias("elem_brand_id"),
    )
    meta = brand_meta.select(F.col("brand_id").alias("elem_brand_id"), "brand_submarket")
    s = F.col("brand_submarket")

    def n(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")

    counts = (
        exploded.join(meta, "elem_brand_id", "left")
        .groupBy("customer_id", "order_id", "order_date", "order_sequence", "order_year", "order_from_lux")
        .agg(
            n(s.isin(*MASS)).alias("mass"),
            n(s == PRESTIGE).alias("prestige"),
            n(s == PRESTIGE_LUX).alias("prestige_lux"),
            n(~s.isin(*MASS, PRESTIGE, PRESTIGE_LUX)).alias("na"),
        )
    )
    m, p, x, na = F.col("mass"), F.col("prestige"), F.col("prestige_lux"), F.col("na")
    order_type = (
        F.when((m == 1) & (p == 0) & (x == 0) & (na == 0), "Mass_Only")
        .when((m == 1) & (p == 1) & (x == 0), "Mass_Prestige_Combo")
        .when((m == 1) & (p == 0) & (x == 1), "Mass_Lux_Combo")
        .when((m == 0) & (p == 1) & (x == 0), "Prestige_Only")
        .when((m == 0) & (p == 0) & (x == 1), "Lux_Only")
        .when((m == 0) & (p == 1) & (x == 1), "Lux_Prestige_Combo")
    )
    return counts.withColumn("order_type", order_type)


def orders_around_entry(
    tx: DataFrame | CustomerFacts,
    brand_meta: DataFrame,
    window: Window,
    brand_ids: Iterable[int],
    category: str,
    *,
    radius: int = 5,
    site_id: int | None = 37,
    excluded_countries=("US", "Australia"),
) -> DataFrame:
    """Order counts by (year, offset from the first luxury order, type) (A4)."""
    base = base_orders(tx, window, site_id=site_id, excluded_countries=excluded_countries)
    typed = order_submarket_counts(customer_order_offsets(base, brand_ids, category), brand_meta)
    return (
        typed.filter(F.col("order_from_lux").between(-radius, radius))
        .groupBy("order_year", "order_from_lux", "order_type")
        .agg(
            F.count(F.lit(1)).alias("orders_count"),
            F.sum("mass").cast("bigint").alias("total_mass"),
            F.sum("prestige").cast("bigint").alias("total_prestige"),
            F.sum("prestige_lux").cast("bigint").alias("total_prestige_lux"),
        )
        .orderBy("order_year", "order_from_lux")
    )
