"""Daily prices from a row per sku against those from a row per sku and day."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tillroll.functions.windows import Window, dates_between
from tillroll.operators import pricing as prc
from tillroll.sources import canonical as canon

D = dt.date
WINDOW = Window(D(2000, 7, 1), D(2000, 7, 12))
LIST = "Product_key bigint, Site_Key int, Locale_Key int, Currency_Key int, Valid_From date, Valid_To date, RRP decimal(18,2), Price decimal(18,2)"


def price_list(rng):
    out = []
    for p in range(30):
        for site, loc in ((37, 3), (37, 6), (231, 6)):
            for _ in range(rng.choice([0, 1, 2, 5])):
                start = rng.choice([None, *[D(2000, 6, 25) + dt.timedelta(days=i) for i in range(20)]])
                end = rng.choice([None, D(9999, 12, 31), *[D(2000, 6, 25) + dt.timedelta(days=i) for i in range(25)]])
                rrp, price = rng.choice([(10, 8), (10, 10), (None, 7), (9, None), (10, 8)])
                money = [None if x is None else Decimal(x) for x in (rrp, price)]
                out += [(p if p else None, site, loc, rng.choice([1, 2, 2 if loc == 3 else 1]), start, end, *money)] * rng.choice([1, 1, 2])
    return out


def inputs(spark, seed):
    rng = random.Random(seed)
    current, historic = (spark.createDataFrame(price_list(rng), LIST) for _ in range(2))
    rows = [(p, p if p else None, f"t{p}", s, "S", loc, "L", 1, "B", "", "", rng.choice([None, "", "c"]), "") for p in range(31) for s in (37, 231) for loc in (3, 6) for _ in range(1 + (p % 4 == 0))]
    skus = spark.createDataFrame(
        rows, "Product_Id bigint, product_key bigint, Product_Title string, Site_Key int, Site string, Locale_Key int, Locale string, "
        "Brand_key bigint, Brand_Name string, Brand_Submarket string, Brand_Category string, Category string, Subcategory string",
    ).distinct().join(prc.price_list_state(current), prc.SKU, "left")
    days = [d for d in dates_between(Window(D(2000, 6, 1), D(2000, 8, 1))) if d != D(2000, 7, 4)]
    return skus, spark.createDataFrame([(d,) for d in days + days[:40]], "full_date date"), current, historic


def test_equals_the_prices_of_each_day(spark):
    for seed in range(3):
        skus, calendar, current, historic = inputs(spark, seed)
        each = skus.withColumn("Date", F.explode(F.sequence(F.lit(WINDOW.start), F.lit(WINDOW.end))))
        grid = each.join(calendar.select(F.col("full_date").alias("Date")), "Date", "left_semi")
        want = sorted(map(str, prc.daily_prices(grid, current, historic, WINDOW).collect()))
        for buckets in (None, 3):
            got = prc.daily_prices_by_sku(skus, calendar, current, historic, WINDOW, buckets)
            assert sorted(map(str, got.collect())) == want and len(want) > 300


def test_days_do_not_cross_the_network(spark):
    skus, calendar, current, historic = inputs(spark, 7)
    plan = prc.daily_prices_by_sku(skus, calendar, current, historic, WINDOW, 3)._jdf.queryExecution().executedPlan().toString()
    before_days = plan[: plan.index("sequence(Date")]
    assert "Exchange hashpartitioning" not in before_days.split("BroadcastExchange")[0] and "Exchange hashpartitioning" in plan


def test_buckets_follow_the_skus(spark):
    assert prc.daily_buckets(spark, 10, WINDOW) == spark.sparkContext.defaultParallelism
    assert prc.daily_buckets(spark, 28_800_000, WINDOW) == 346


def test_calendar_needs_no_facts(spark, tmp_path, monkeypatch):
    """The months of the lines from keys alone are those of the fact table."""
    sf = "/root/testdata/sf0.001"
    li, orders = spark.read.parquet(f"{sf}/lineitem.parquet"), spark.read.parquet(f"{sf}/orders.parquet")
    for t in ("part", "customer", "nation", "region"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    first, last = orders.agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    gone = orders.where((F.col("o_orderdate") < F.lit(first) + F.expr("interval 70 days")) & (F.col("o_orderkey") % 2 == 0)).select(F.col("o_orderkey").alias("l_orderkey"))
    orders = orders.withColumn("o_custkey", F.when(F.datediff(F.lit(last), "o_orderdate") < 70, None).otherwise(F.col("o_custkey")))
    li.join(gone, "l_orderkey", "left_anti").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    months = [F.min("order_month"), F.max("order_month")]
    want = canon.transactions(spark, str(tmp_path)).agg(*months).first()
    assert canon.line_months(spark, str(tmp_path)).agg(*months).first() == want
    calls = []
    monkeypatch.setattr(canon, "customer_facts", lambda *a: calls.append(a))
    assert canon.calendar(spark, str(tmp_path)).count() > 700 and not calls
