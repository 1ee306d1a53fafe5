"""Edge cases of the SURVEY semantics table, on hand-made frames."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tests.frames import D, line, tx
from tillroll.functions.windows import Window
from tillroll.operators import bundles as bun
from tillroll.operators import category_mix as mix
from tillroll.operators import frequency as freq
from tillroll.operators import luxury_entry as lux
from tillroll.operators import reorder as reo
from tillroll.operators import retention as ret
from tillroll.operators import titles as ttl
from tillroll.operators import top_products as top

Y2000 = Window(D(2000, 1, 1), D(2000, 12, 31))


def test_retention_rows_exist_when_empty(spark):
    """Every cohort row is returned, with zeros, even with no data."""
    df = tx(spark, [line(1, 1, D(1990, 5, 1))])
    out = ret.retention_cohorts(df, brand_id=1, start_year=1997).collect()
    assert [r["cohort"] for r in out] == ["1997 Retention", "1998 Retention", "1999 Retention"]
    assert all(r["Year_1"] == r["Year_2"] == r["Year_3"] == 0 for r in out)


def test_retention_counts_members_only(spark):
    rows = [
        line(1, 1, D(1997, 3, 1)), line(1, 2, D(1998, 3, 1)), line(1, 3, D(2001, 3, 1)),
        line(2, 4, D(1998, 6, 1)), line(2, 5, D(1999, 6, 1)), line(2, 6, D(2000, 6, 1)),
        line(3, 7, D(1999, 1, 1), brand=2),  # other brand
        line(None, 8, D(1997, 1, 1)),  # NULL customer never counts
    ]
    out = {r["cohort"]: (r["Year_1"], r["Year_2"], r["Year_3"]) for r in
           ret.retention_cohorts(tx(spark, rows), 1, 1997).collect()}
    assert out == {"1997 Retention": (1, 1, 0), "1998 Retention": (2, 1, 1), "1999 Retention": (1, 1, 0)}


def test_order_frequency_buckets_and_null_customer(spark):
    """NULL customers form a bucket row that counts 0."""
    rows = [line(1, 1, D(2000, 1, 1))] + [line(2, o, D(2000, 2, o)) for o in range(10, 15)]
    rows += [line(None, 30, D(2000, 3, 1))]
    out = {r["order_frequency"]: r["num_customers"] for r in
           freq.order_frequency(tx(spark, rows), Y2000, [1], "Hair", excluded_countries=["US"]).collect()}
    # The NULL customer's bucket row merges with "1 order" and adds 0.
    assert out == {"1 order": 1, "4 or more orders": 1}


def test_customer_types(spark):
    rows = [
        line(1, 1, D(1998, 1, 1)),  # one_time
        line(2, 2, D(1998, 1, 1)), line(2, 3, D(1999, 1, 1)),  # consistent_once
        line(3, 4, D(1998, 1, 1)), line(3, 5, D(1998, 2, 1)),  # other
    ]
    w = Window(D(1998, 1, 1), D(2000, 12, 31))
    out = {r["order_year"]: tuple(r)[1:] for r in
           freq.customer_types_by_year(tx(spark, rows), w, [1], "Hair", excluded_countries=["US"]).collect()}
    assert out == {1998: (1, 1, 1, 3), 1999: (0, 1, 0, 1)}


def test_category_mix_null_and_three_categories(spark):
    """A NULL category sets no flag; three named categories fall in no bucket."""
    rows = [
        line(1, 1, D(2000, 1, 1), category="Hair"), line(1, 1, D(2000, 1, 1), category="Skin"),
        line(1, 2, D(2000, 1, 2), category="Hair"), line(1, 2, D(2000, 1, 2), category="Skin"),
        line(1, 2, D(2000, 1, 2), category="Body"),
        line(1, 3, D(2000, 1, 3), category=None),
        line(1, 4, D(2000, 1, 4), category="Shoes"), line(1, 4, D(2000, 1, 4), category="Hair"),
    ]
    r = mix.category_mix(tx(spark, rows), Y2000, [1], excluded_countries=["US"]).first().asDict()
    assert r["Orders"] == 4 and r["Hair_Skin"] == 1 and r["Other_with_Category"] == 1
    assert sum(v for k, v in r.items() if k != "Orders") == 2  # order 2 and order 3 in no bucket


def test_gaps_ignore_same_day_lines_and_stats_null_for_one_gap(spark):
    """Same-day lines give no gap; one gap -> NULL stddev -> fallback bucket."""
    rows = [
        line(1, 1, D(2000, 1, 1)), line(1, 1, D(2000, 1, 1), product=2),
        line(1, 2, D(2000, 1, 11)),
        line(2, 3, D(2000, 6, 1)),
    ]
    df = tx(spark, rows)
    w = Window(D(2000, 1, 1), D(2000, 12, 31))
    gaps = reo.order_gaps(df, w, 1, excluded_countries=["US"]).collect()
    assert [(g["customer_id"], g["days_between"]) for g in gaps] == [(1, 10)]
    customers = reo.customer_recency(df, w, 1, excluded_countries=["US"])
    stats = reo.gap_stats(reo.order_gaps(df, w, 1, excluded_countries=["US"]), customers).first()
    assert stats["avg_time"] == 10.0 and stats["std_dev"] is None
    buckets = {r["customer_id"]: r["activity_bucket"] for r in reo.activity_buckets(customers, reo.gap_stats(
        reo.order_gaps(df, w, 1, excluded_countries=["US"]), customers)).collect()}
    assert buckets == {1: reo.NO_BUCKET, 2: reo.NO_BUCKET}


def test_brand_activity_counts_add_up(spark):
    rows = [line(c, 10 * c + k, D(2000, 1 + k, 1 + c)) for c in range(1, 6) for k in range(c)]
    rows += [line(5, 99, D(2000, 12, 1), brand=2, category="Hair")]
    out = reo.brand_activity(tx(spark, rows), Window(D(2000, 1, 1), D(2000, 12, 31)), 1, "Hair",
                             excluded_countries=["US"]).collect()
    seg = {r["segment"]: r["customers"] for r in out}
    parts = seg["Active Customers"] + seg["Lapsing Customers"] + seg["Lapsed Customers"]
    assert seg["Total Brand Customers"] == 5 and parts <= 5


def test_top_products_ties_break_on_product_id(spark):
    """Ties at the cut are broken by product_id; ranks are global ranks."""
    rows = [line(1, p, D(2000, 1, 1), product=p, units=5, new=True) for p in range(1, 5)]
    rows += [line(2, 9, D(2000, 1, 2), product=9, units=7, new=True)]
    products = spark.createDataFrame([(p, f"t{p}") for p in (1, 2, 3, 4, 9)], "product_id bigint, product_title string")
    out = top.top_products(tx(spark, rows), products, Y2000, 1, "Hair", True, k=3, excluded_countries=["US"]).collect()
    assert [(r["product_id"], r["rank"]) for r in out] == [(9, 1), (1, 2), (2, 2)]


def test_order_type_labels(spark):
    """Exactly-one counts give a label, the rest NULL; brands without
    metadata add to no counter."""
    meta = spark.createDataFrame(
        [(1, "Mass"), (2, "Prestige"), (3, "Prestige-Lux"), (4, "Mass"), (5, "Niche")],
        "brand_id bigint, brand_submarket string",
    )
    orders = spark.createDataFrame(
        [(1, o, D(2000, 1, o), o, 2000, 0, b) for o, b in
         [(1, [1]), (2, [1, 2]), (3, [1, 3]), (4, [2]), (5, [3]), (6, [2, 3]), (7, [1, 4]), (8, [1, 5]), (9, [7])]],
        "customer_id bigint, order_id bigint, order_date date, order_sequence bigint, order_year bigint, "
        "order_from_lux bigint, brand_ids array<bigint>",
    )
    got = {r["order_id"]: r["order_type"] for r in lux.order_submarket_counts(orders, meta).collect()}
    assert got == {1: "Mass_Only", 2: "Mass_Prestige_Combo", 3: "Mass_Lux_Combo", 4: "Prestige_Only",
                   5: "Lux_Only", 6: "Lux_Prestige_Combo", 7: None, 8: None, 9: None}


def test_entry_offsets_relative_to_first_luxury_order(spark):
    rows = [
        line(1, 1, D(2000, 1, 1), brand=1, seq=1), line(1, 2, D(2000, 2, 1), brand=9, seq=2),
        line(1, 3, D(2000, 3, 1), brand=1, seq=3), line(2, 4, D(2000, 1, 1), brand=1, seq=1),
    ]
    df = tx(spark, rows).withColumn("category", F.when(F.col("brand_id") == 9, "Fragrance").otherwise("Hair"))
    base = lux.base_orders(df, Y2000, site_id=None, excluded_countries=["US"])
    entry = lux.entry_event(base, [9], "Fragrance")
    got = {r["order_id"]: r["order_from_lux"] for r in lux.order_offsets(base, entry).collect()}
    assert got == {1: -1, 2: 0, 3: 1}


def test_title_regex_semantics(spark):
    """First digit run (decimals cut), first unit token anywhere, case-sensitive."""
    titles = spark.createDataFrame(
        [(1, "Shampoo 12.5ml"), (2, "Strong 8fl.oz"), (3, "Gel 5 gallons"), (4, "Plain"), (5, "Oil 250ML"),
         (6, "Tub 99999999999999999999 oz")],
        "product_id bigint, product_title string",
    )
    attrs = spark.createDataFrame([(i, "Hair") for i in range(1, 7)], "product_id bigint, category string")
    got = {r["product_id"]: (r["volume"], r["volume_unit"]) for r in
           ttl.title_volume_unit(titles, attrs, "Hair").collect()}
    assert got == {1: (12, "ml"), 2: (8, "g"), 3: (5, "g"), 4: (None, None), 5: (250, None), 6: (None, "oz")}


def test_bundle_weights_default_and_repeat(spark):
    """Junk weight counts 100, missing Qty 1; bundle measures repeat per child."""
    lines = spark.createDataFrame(
        [(2000, D(2000, 5, 1), 1, "B1", "Hair", 10, 1000010, 1, 2, Decimal("100.00"), "A", "EU", 0, 0)],
        "Year bigint, Order_Date date, Brand_Key bigint, Brand_Name string, Category string, product_id bigint, "
        "Product_Key bigint, Is_Bundle int, Units bigint, list_price decimal(18,2), Business_Unit string, "
        "Country_Group string, Is_GWP int, Order_Payment_Status_Key int",
    )
    lines = lines.withColumn("order_month", F.lit(200005))
    for c in ["product_revenue", "product_net_revenue", "rrp", "Shipping_Net_Revenue", "product_cost",
              "Total_Discount", "funded", "gp"]:
        lines = lines.withColumn(c, F.col("list_price"))
    products = spark.createDataFrame(
        [(10, 1000010, "bundle"), (11, 1000011, "c1"), (12, 1000012, "c2")],
        "product_id bigint, product_key bigint, product_title string",
    )
    bundles = spark.createDataFrame(
        [(10, 1000010, "bundle", "B1", "Hair", 11, "c1", "B1", "Hair", 1, "50"),
         (10, 1000010, "bundle", "B1", "Hair", 12, "c2", "B1", "Hair", None, "n/a")],
        "Bundle_Product_Id bigint, Bundle_Product_Key bigint, Bundle_Product_Title string, Bundle_Brand_Name string, "
        "Bundle_Category string, Child_Product_Id bigint, Child_Product_Title string, Child_Brand_Name string, "
        "Child_Category string, Qty bigint, Cost_Weight string",
    )
    fix = spark.createDataFrame([], "wrong_brand_key bigint, correct_brand_key bigint, correct_brand_name string")
    w = Window(D(2000, 1, 1), D(2000, 12, 31))
    flt = bun.bundle_line_filter(w, w, ["A"], "C", ["X"])
    got = {r["Child_Product_Id"]: (r["Child_Units"], r["Child_List_Revenue"], r["Bundle_List_Revenue"])
           for r in bun.bundle_revenue(lines, products, bundles, fix, flt).collect()}
    assert got == {11: (2, 50.0, 100.0), 12: (2, 100.0, 100.0)}


def test_basket_rank_scope(spark):
    """By default the top-k spans business units; optionally per unit."""
    from tillroll.operators import basket as bsk

    rows = []
    for o, unit in [(1, "U1"), (2, "U1"), (3, "U2")]:
        rows += [line(o, o, D(2000, 1, o), brand=1, product=1, unit=unit),
                 line(o, o, D(2000, 1, o), brand=2, product=2 if unit == "U1" else 3, unit=unit)]
    products = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "product_id bigint, product_title string")
    df = tx(spark, rows)
    one = bsk.basket_cross_sell(df, products, Y2000, [1], k=1).collect()
    assert [(r["business_unit"], r["co_product_id"], r["orders_together"]) for r in one] == [("U1", 2, 2)]
    per = bsk.basket_cross_sell(df, products, Y2000, [1], k=1, per_business_unit=True).collect()
    assert sorted((r["business_unit"], r["co_product_id"]) for r in per) == [("U1", 2), ("U2", 3)]


def test_basket_counts_a_product_once_per_order(spark):
    """Repeated lines of a product, and two brand keys of one product, count an order once."""
    from tillroll.operators import basket as bsk

    rows = [line(1, 1, D(2000, 1, 1), brand=1, product=1)] * 3 + [line(1, 1, D(2000, 1, 1), brand=2, product=2)] * 2
    rows += [line(2, 2, D(2000, 1, 2), brand=1, product=1), line(2, 2, D(2000, 1, 2), brand=2, product=2), line(3, 3, D(2000, 1, 3), brand=2, product=2)]
    products = spark.createDataFrame([(1, "a"), (2, "b")], "product_id bigint, product_title string")
    got = bsk.basket_pairs(tx(spark, rows), products, Y2000, [1]).collect()
    assert [(r["target_product_id"], r["co_product_id"], r["co_product_title"], r["orders_together"]) for r in got] == [(1, 2, "b", 2)]
