"""Customer bitmaps against COUNT(DISTINCT) over the lines."""

import itertools

import pytest
from pyspark.sql import functions as F

from tillroll import registry
from tillroll.operators import distinct_customers as dis

DIMS = ["country_group", "category"]


@pytest.fixture(scope="module")
def frames(spark):
    """One customer with a third of the lines, ids far apart, some lines without a customer."""
    n = F.col("id")
    who = F.when(n % 3 == 0, 7).when(n % 50 == 1, None).when(n % 5 == 0, n * 40_000_000_007).otherwise(n % 400 * 300)
    lines = spark.range(5000).select(
        who.alias("customer_id"), (n % 4).cast("string").alias("country_group"), F.when(n % 11 != 0, (n % 7).cast("string")).alias("category"),
        (20010600 + n % 30).alias("date_key"), F.lit(200106).alias("order_month"),
    )
    days = [(20010600 + i, 200106, m, "TY" if i < 20 else None, "LY" if i % 3 == 0 else None, "LY_AL" if i % 2 else None) for i in range(30) for m in ("200106", "200107")]
    periods = spark.createDataFrame(days, "date_key long, order_month int, calendar_year_month string, period_ty string, period_ly string, period_ly_al string")
    return lines, periods


@pytest.mark.parametrize("by", [s for k in range(3) for s in itertools.combinations(DIMS, k)])
def test_every_subset_equals_count_distinct(frames, by):
    lines, periods = frames
    got = dis.distinct_customers(dis.customer_bitmaps(lines, periods, DIMS), by)
    flat = periods.select("date_key", "calendar_year_month", F.explode(F.array("period_ty", "period_ly", "period_ly_al")).alias("period")).where("period is not null")
    want = lines.join(flat, "date_key").groupBy("calendar_year_month", "period", *by).agg(F.countDistinct("customer_id").alias("customers")).where("customers > 0")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() >= 6


def test_no_lines(frames):
    lines, periods = frames
    assert dis.customers_by_subsets(dis.customer_bitmaps(lines.where("false"), periods, DIMS), DIMS, [[], DIMS]).collect() == []


def test_lines_are_scanned_once_and_totals_read_the_bitmaps(spark):
    plan = registry.QUERIES["kpi_distinct_customers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "customer_facts" not in plan and "lineitem" not in plan
