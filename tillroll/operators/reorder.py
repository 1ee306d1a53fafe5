"""Reorder rhythm: reorder interval (A2) and brand activity segments (A10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.filters import valid_line
from tillroll.functions.windows import Window
from tillroll.plans.written import written
from tillroll.sources.customers import CustomerFacts, per_customer

EXCLUDED = ("US", "Australia")
# Fixed value: the label for customers that fit no bucket.
NO_BUCKET = "¯\\_(ツ)_/¯"


def _pred(window, brand_id, category, business_unit, excluded_countries):
    return valid_line(
        window,
        excluded_countries=excluded_countries,
        business_unit=business_unit,
        brand_ids=[brand_id],
        category=category,
        customer_not_null=True,
    )


def customer_rhythm(
    tx: DataFrame | CustomerFacts,
    window: Window,
    brand_id: int,
    category: str | None = None,
    *,
    business_unit: str | None = "CORE",
    excluded_countries=EXCLUDED,
) -> DataFrame:
    """Per customer, from one scan: last order date, distinct orders, and the
    distinct purchase days in order (at most the days of the window).

    Distinct days and orders are combined map-side, so a hot customer sends a
    row per order and task; on the customer layout there is no shuffle.
    """
    pred = _pred(window, brand_id, category, business_unit, excluded_countries)
    return per_customer(
        tx,
        lambda lines: lines.filter(pred)
        .groupBy("customer_id")
        .agg(
            F.max("order_date").alias("last_order_date"),
            F.countDistinct("order_id").alias("total_orders"),
            F.array_sort(F.collect_set("order_date")).alias("days"),
        ),
    )


def recency_of(rhythm: DataFrame, window: Window) -> DataFrame:
    """Last order date, days from it to the window end, distinct orders."""
    since = F.datediff(F.lit(window.end), F.col("last_order_date")).cast("bigint")
    return rhythm.select("customer_id", "last_order_date", since.alias("days_since_last_order"), "total_orders")


def gaps_of(rhythm: DataFrame) -> DataFrame:
    """Positive day gaps between a customer's consecutive purchase dates.

    The reference takes LAG over order *lines*; lines on the same day give a
    zero gap that is filtered out later, so the positive gaps are exactly the
    differences between consecutive distinct dates.
    """
    n = F.size("days")
    pairs = F.arrays_zip(F.slice("days", F.lit(2), n).alias("day"), F.slice("days", F.lit(1), F.greatest(n - 1, F.lit(0))).alias("before"))
    days = rhythm.select("customer_id", "total_orders", F.explode(pairs).alias("p"))
    return days.select(
        "customer_id",
        F.col("p.day").alias("order_date"),
        F.col("p.before").alias("prev_order_date"),
        F.datediff("p.day", "p.before").cast("bigint").alias("days_between"),
        "total_orders",
    )


def customer_recency(tx: DataFrame | CustomerFacts, window: Window, brand_id: int, category: str | None = None, **opts) -> DataFrame:
    return recency_of(customer_rhythm(tx, window, brand_id, category, **opts), window)


def order_gaps(tx: DataFrame | CustomerFacts, window: Window, brand_id: int, category: str | None = None, **opts) -> DataFrame:
    return gaps_of(customer_rhythm(tx, window, brand_id, category, **opts)).drop("total_orders")


def _mean_and_deviation(gaps: DataFrame) -> DataFrame:
    return gaps.agg(F.avg("days_between").alias("avg_time"), F.stddev_samp("days_between").alias("std_dev"))


def gap_stats(gaps: DataFrame, customers: DataFrame) -> DataFrame:
    """One row: mean and sample standard deviation of the gaps of customers
    with more than one order (B7).  Always one row (NULLs when empty)."""
    repeat = customers.filter(F.col("total_orders") > 1).select("customer_id")
    return _mean_and_deviation(gaps.join(repeat, "customer_id"))


def rhythm_stats(rhythm: DataFrame) -> DataFrame:
    """``gap_stats`` from the rows of ``customer_rhythm``, without a join."""
    return _mean_and_deviation(gaps_of(rhythm.filter(F.col("total_orders") > 1)))


def reorder_interval(tx: DataFrame | CustomerFacts, window: Window, brand_id: int, category: str | None = None, **opts) -> DataFrame:
    s = rhythm_stats(customer_rhythm(tx, window, brand_id, category, **opts))
    return s.select(
        F.round("avg_time", 6).alias("avg_days_between_orders"),
        F.round("std_dev", 6).alias("std_dev_between_orders"),
    )


def gap_bounds(stats: DataFrame) -> DataFrame:
    """Mean +/- 2 standard deviations."""
    return stats.select(
        "avg_time",
        "std_dev",
        (F.col("avg_time") - 2 * F.col("std_dev")).alias("lower_bound"),
        (F.col("avg_time") + 2 * F.col("std_dev")).alias("upper_bound"),
    )


def activity_buckets(customers: DataFrame, stats: DataFrame) -> DataFrame:
    """Active / Lapsing / Lapsed by days since last order against the gap
    statistics (B9).  ``stats`` is one global-aggregate row, so the cross join
    adds columns, not rows."""
    d = F.col("days_since_last_order")
    avg, sd = F.col("avg_time"), F.col("std_dev")
    bucket = (
        F.when(d < avg, "Active")
        .when(d.between(avg, avg + sd), "Lapsing")
        .when(d > avg + sd, "Lapsed")
        .otherwise(NO_BUCKET)
    )
    joined = customers.crossJoin(F.broadcast(stats))
    return joined.select("customer_id", "last_order_date", bucket.alias("activity_bucket"))


def active_elsewhere(
    tx: DataFrame | CustomerFacts,
    buckets: DataFrame,
    window: Window,
    brand_id: int,
    *,
    business_unit: str | None = "CORE",
    excluded_countries=EXCLUDED,
) -> DataFrame:
    """Orders of Lapsing/Lapsed customers at other brands after their last
    order of the brand (B10).  The lost customers (a row each) are written: on
    the customer layout they are sent to the customers' buckets, and elsewhere
    the lines of a hot customer can be split (plans.written)."""
    lost = buckets.filter(F.col("activity_bucket").isin("Lapsed", "Lapsing")).select(
        "customer_id", F.col("last_order_date").alias("_last")
    )
    lost = written(lost, "lost-customers")
    pred = valid_line(
        window, excluded_countries=excluded_countries, business_unit=business_unit, customer_not_null=True
    ) & (F.col("brand_id") != brand_id)
    return per_customer(
        tx,
        lambda lines: lines.filter(pred)
        .select("customer_id", "order_id", "order_date", "category", "brand_id", "brand_name")
        .join(lost, "customer_id")
        .filter(F.col("order_date") > F.col("_last"))
        .groupBy(
            "customer_id",
            "category",
            F.col("brand_id").alias("alt_brand_id"),
            F.col("brand_name").alias("alt_brand_name"),
        )
        .agg(F.countDistinct("order_id").alias("alt_orders")),
    )


def brand_activity(
    tx: DataFrame | CustomerFacts,
    window: Window,
    brand_id: int,
    category: str,
    *,
    business_unit: str | None = "CORE",
    excluded_countries=EXCLUDED,
) -> DataFrame:
    """segment, customers, sort_order (A10).

    The brand's customers are not filtered by category; the category only
    selects the 'Moved to Brand' rows.  The customers' buckets are written
    once (a row per customer) and read by the counts and the destinations; the
    five headline counts come from one aggregate (always a row).
    """
    opts = dict(business_unit=business_unit, excluded_countries=excluded_countries)
    rhythm = written(customer_rhythm(tx, window, brand_id, None, **opts), "customer-rhythm")
    buckets = written(activity_buckets(recency_of(rhythm, window), rhythm_stats(rhythm)), "activity-buckets")
    elsewhere = active_elsewhere(tx, buckets, window, brand_id, **opts)

    # ``buckets`` has one row per (non-NULL) customer, so the distinct counts
    # of the report are plain conditional counts: one partial aggregate per
    # task, no Expand.
    b = F.col("activity_bucket")
    head = buckets.agg(
        F.count("customer_id").alias("total"),
        F.count_if(b == "Active").alias("active"),
        F.count_if(b == "Lapsing").alias("lapsing"),
        F.count_if(b == "Lapsed").alias("lapsed"),
    )
    head_rows = head.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(label).alias("segment"), F.col(c).alias("customers"), F.lit(i).cast("bigint").alias("sort_order"))
                    for i, (label, c) in enumerate(
                        [
                            ("Total Brand Customers", "total"),
                            ("Active Customers", "active"),
                            ("Lapsing Customers", "lapsing"),
                            ("Lapsed Customers", "lapsed"),
                        ],
                        start=1,
                    )
                ]
            )
        ).alias("r")
    ).select("r.*")
    # One pass over the destinations: a customer's rows become its brands in
    # the category; the customer counts once anywhere and once per brand.
    in_category = F.when(F.col("category") == category, F.struct("alt_brand_name"))
    seen = elsewhere.groupBy("customer_id").agg(F.collect_set(in_category).alias("brands"))
    rows5 = F.struct(F.lit("Lapsed/Lapsing Active Elsewhere").alias("segment"), F.lit(5).cast("bigint").alias("sort_order"))
    moved = F.transform(
        "brands", lambda b: F.struct(F.concat(F.lit("Moved to Brand "), b["alt_brand_name"]).alias("segment"), F.lit(6).cast("bigint").alias("sort_order"))
    )
    elsewhere_rows = (
        seen.select(F.explode(F.concat(F.array(rows5), moved)).alias("r"))
        .groupBy("r")
        .agg(F.count(F.lit(1)).alias("customers"))
        .select("r.segment", "customers", "r.sort_order")
    )
    # the headline row of row 5 exists also when nobody is active elsewhere
    none = head.select(rows5.alias("r"), F.lit(0).cast("bigint").alias("customers")).select("r.segment", "customers", "r.sort_order")
    found = elsewhere_rows.unionByName(none).groupBy("segment", "sort_order").agg(F.max("customers").alias("customers"))
    return head_rows.unionByName(found.select("segment", "customers", "sort_order")).orderBy("sort_order", F.desc("customers"))
