"""Invariants of the analyses on the sf0.01 tables."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillroll.registry import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: QUERIES[name](spark, SF)


def test_category_mix_buckets_within_orders(run):
    r = run("category_mix").first().asDict()
    assert sum(v for k, v in r.items() if k != "Orders") <= r["Orders"]


def test_activity_segments_add_up(run):
    seg = {r["segment"]: r["customers"] for r in run("brand_activity").collect()}
    buckets = run("activity_buckets").groupBy("activity_bucket").count().collect()
    assert sum(r["count"] for r in buckets) == seg["Total Brand Customers"]
    assert seg["Active Customers"] + seg["Lapsing Customers"] + seg["Lapsed Customers"] <= seg["Total Brand Customers"]


def test_buyer_types_add_up_per_year(run):
    for r in run("customer_types_by_year").collect():
        assert r["one_time_buyers"] + r["consistent_once_buyers"] + r["other_buyers"] == r["total_customers"]


def test_retention_never_exceeds_cohort(run):
    for r in run("retention_cohorts").collect():
        assert r["Year_1"] >= r["Year_2"] and r["Year_1"] >= r["Year_3"]


def test_islands_alternate_flags(run):
    islands = run("campaign_islands")
    w = W.partitionBy("Product_Id", "Site_Key", "Locale_Key").orderBy("Change_Group")
    prev = islands.withColumn("prev", F.lag("Campaign_Flag").over(w))
    assert prev.filter(F.col("prev") == F.col("Campaign_Flag")).count() == 0


def test_top_products_ranks_are_ordered(run):
    rows = run("top_products_new").orderBy("rank_ntb").collect()
    units = [r["total_units"] for r in rows]
    assert units == sorted(units, reverse=True) and rows[0]["rank_ntb"] == 1


def test_basket_top_k_at_most_three(run):
    per = run("basket_cross_sell").groupBy("target_product_id").count()
    assert per.agg(F.max("count")).first()[0] <= 3
