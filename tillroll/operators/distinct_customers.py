"""Distinct customers that can be added up again (G6, G7, B45, ruling S17).

Counts of distinct customers do not add: a customer of two categories is one
customer of both.  Here each (period, dimensions) keeps the *set* of its
customers as bitmaps: ``bitmap_bucket_number`` deals the ids over buckets of
32,768, and a bucket is 4 KB whatever it holds.  Any coarser total is a union of
bitmaps (``bitmap_or_agg``) and their counts, exact, without going back to the
lines.  One grouped aggregate over the lines builds them, combined map-side, so
a customer with a third of all lines sets one bit per task.

A bitmap costs 4 KB per group and bucket it occurs in, so dimensions should be
few: brand, country or category, not all fifteen of the monthly table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.kpi import PERIODS
from tillroll.sources.customers import CustomerFacts, lines_of

KEYS = ["calendar_year_month", "period"]


def customer_bitmaps(daily_base: DataFrame | CustomerFacts, periods: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Rows (month, period, dims, bucket, customers): the customers with a line
    in the period, ids of one bucket as a bitmap.  Lines without a customer
    count nowhere.  ``periods`` is the bounded period calendar."""
    labels = F.explode(F.array_compact(F.array(*[F.col(f"period_{p}") for p, _ in PERIODS]))).alias("period")
    by_date = F.broadcast(periods.select("date_key", "order_month", "calendar_year_month", labels))
    lines = lines_of(daily_base).where("customer_id is not null").join(by_date, ["date_key", "order_month"])
    bits = lines.select(*KEYS, *dims, F.bitmap_bucket_number("customer_id").alias("bucket"), F.bitmap_bit_position("customer_id").alias("bit"))
    return bits.groupBy(*KEYS, *dims, "bucket").agg(F.bitmap_construct_agg("bit").alias("customers"))


def distinct_customers(bitmaps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct customers per month, period and ``by`` (some of the dimensions)."""
    united = bitmaps.groupBy(*KEYS, *by, "bucket").agg(F.bitmap_or_agg("customers").alias("customers"))
    return united.groupBy(*KEYS, *by).agg(F.sum(F.bitmap_count("customers")).alias("customers"))


def customers_by_subsets(bitmaps: DataFrame, dims: Sequence[str], subsets: Sequence[Sequence[str]]) -> DataFrame:
    """``distinct_customers`` for several subsets of ``dims`` in one frame;
    ``level`` names the subset, other dimensions are NULL."""
    out = None
    for by in subsets:
        columns = [F.col(d) if d in by else F.lit(None).cast(bitmaps.schema[d].dataType).alias(d) for d in dims]
        rows = distinct_customers(bitmaps, by).select(F.lit(" ".join(by)).alias("level"), *KEYS, *columns, "customers")
        out = rows if out is None else out.unionByName(rows)
    return out
