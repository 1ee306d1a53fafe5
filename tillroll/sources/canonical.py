"""Adapters from the driver's TPC-H-style tables to the retail data model.

The analyses are written against retail tables (order lines, products, brand
attributes, calendars, price lists).  This module derives each of them from the
given tables with plain DataFrame operations, so every analysis reads data
that grows with the inputs.  The mapping itself is documented in FIXTURES.md
section 2-3; the rules here are the single source of truth for it.

Money columns are DECIMAL so that sums are exact and independent of the order
in which partitions are combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.plans.joins import by_shuffle
from tillroll.plans.ranking import row_number_by
from tillroll.plans.written import written
from tillroll.sources.customers import CustomerFacts, first_of, write_customer_facts
from tillroll.sources.tables import read_table, table_path

# ---------------------------------------------------------------------------
# Fixed values of the mapping (kept together, in natural order).
# ---------------------------------------------------------------------------
SITE_CORE, SITE_CULT = 37, 231
SITE_NAMES = {SITE_CORE: "CORE", SITE_CULT: "CULT"}
LOCALES = {3: "UK", 6: "FR"}
SUBMARKETS = ["Mass", "Masstige", "Prestige", "Prestige-Lux", "Niche"]  # by brand_id % 5
BRANDS_WITHOUT_METADATA = (25,)
BRAND_FIXES = [(24, 1), (23, 2)]  # (wrong_brand_key, correct_brand_key)
TITLE_UNITS = ["ml", " oz", "fl.oz", "g", "ML", " gallons", ""]  # by p_partkey % 7
PRODUCT_KEY_OFFSET = 1_000_000
PRICE_SEGMENTS = 12  # k = 0..11; k < 6 historic, k >= 6 current
PRICE_SEGMENT_DAYS = 30
PRICE_EPOCH = "2000-01-01"
OPEN_END = "9999-12-31"

MONEY = "decimal(18,2)"
RATE = "decimal(4,2)"


def _money(col: str) -> Column:
    return F.col(col).cast(MONEY)


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation x region.  nation (25 rows) and region (5 rows) have a fixed size
    by definition of the schema, so broadcasting them is safe."""
    region = read_table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("country_group"))
    nation = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("region"), "n_regionkey")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("nation_key", "country_group", "region")


def customers_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of known nations, with the nation's key (``with_nations``
    adds the names)."""
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation_key"), F.col("c_mktsegment").alias("business_unit"))
    return cust.join(F.broadcast(nations(spark, sf_dir)), "nation_key", "left_semi")


def with_nations(rows: DataFrame, sf_dir: str) -> DataFrame:
    """``rows`` with the names of their nation and its region: added once the
    rows lie where they are read, by a broadcast join."""
    return rows.join(F.broadcast(nations(rows.sparkSession, sf_dir)), "nation_key").drop("nation_key")


def order_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, order_sequence): position of the order in its customer's
    history by (order date, order key).  Order keys are unique, so this equals
    DENSE_RANK over (date, key); it is computed with the skew-safe row number."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return row_number_by(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], out="order_sequence").select(
        "o_orderkey", "order_sequence"
    )


def brand_id_of(p_brand: Column) -> Column:
    return F.substring(p_brand, 7, 10).cast("bigint")


def order_month_of(day: Column) -> Column:
    """yyyyMM as a number: the partition key of the materialized fact table."""
    return (F.year(day) * 100 + F.month(day)).cast("int")


LINE_COLUMNS = [
    "customer_id", "order_id", "order_number", "order_date", "order_month", "brand_id", "brand_key", "brand_name", "category",
    "product_id", "product_key", "product_title", "units", "list_revenue", "gross_revenue", "discount", "tax_rate", "retail_price",
    "business_unit", "country_group", "region", "site_id", "site", "payment_status", "is_gift", "is_gwp",
]


def transactions(spark: SparkSession, sf_dir: str, with_sequence: bool = False) -> DataFrame:
    """Canonical order lines (one row per lineitem row), joined from the raw
    tables on every call.  Analyses normally read ``fact_transactions``."""
    return with_derived_columns(with_nations(joined_lines(spark, sf_dir, with_sequence), sf_dir))


def with_derived_columns(lines: DataFrame) -> DataFrame:
    """The columns that follow from others of a line, added once the lines lie
    where they are written; then any further columns of ``lines``."""
    gross = F.col("list_revenue") * (1 - F.col("discount_rate"))
    out = lines.withColumns({
        "order_number": F.col("order_id"),
        "order_month": order_month_of(F.col("order_date")),
        "brand_key": F.col("brand_id"),
        "product_key": F.col("product_id") + PRODUCT_KEY_OFFSET,
        "gross_revenue": gross.cast("decimal(20,4)"),
        "discount": (F.col("list_revenue") * F.col("discount_rate")).cast("decimal(20,4)"),
        "site": F.when(F.col("site_id") == SITE_CORE, F.lit("CORE")).otherwise(F.lit("CULT")),
        "is_gwp": F.col("is_gift"),
    })
    return out.select(*LINE_COLUMNS, *[c for c in lines.columns if c not in LINE_COLUMNS and c != "discount_rate"])


def joined_lines(spark: SparkSession, sf_dir: str, with_sequence: bool = False) -> DataFrame:
    """The lines with what their orders, customers and parts tell, without the
    columns of ``with_nations`` and ``with_derived_columns``."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
    )
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name", "p_retailprice")
    cust = customers_of_nations(spark, sf_dir).withColumnRenamed("c_custkey", "o_custkey")
    if with_sequence:
        # one row per order on both sides: no key can be hot here
        orders = orders.join(order_sequences(spark, sf_dir), "o_orderkey")
    # The numbered orders with their customers are written once: the line join
    # then has two plain scans as inputs, and Spark can split a hot order
    # (plans.written).  Lineitem is scanned once.
    orders = written(orders.join(cust, "o_custkey"), "orders-with-customers")
    tx = li.join(orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    tx = tx.join(part.withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    tx = tx.withColumn("o_orderkey", F.col("l_orderkey")).withColumn("p_partkey", F.col("l_partkey"))
    cols = [
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        brand_id_of(F.col("p_brand")).alias("brand_id"),
        F.col("p_brand").alias("brand_name"),
        F.col("p_type").alias("category"),
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_title"),
        F.col("l_quantity").cast("bigint").alias("units"),
        _money("l_extendedprice").alias("list_revenue"),
        F.col("l_discount").cast(RATE).alias("discount_rate"),
        F.col("l_tax").cast(RATE).alias("tax_rate"),
        _money("p_retailprice").alias("retail_price"),
        "business_unit",
        "nation_key",
        F.when(F.col("l_linestatus") == "O", F.lit(SITE_CORE)).otherwise(F.lit(SITE_CULT)).alias("site_id"),
        F.when(F.col("o_orderstatus") == "P", F.lit("Pending")).otherwise(F.lit("Paid")).alias("payment_status"),
        (F.col("l_returnflag") == "R").alias("is_gift"),
    ]
    if with_sequence:
        cols.append("order_sequence")
    return tx.select(*cols)


_FACTS: dict[tuple, CustomerFacts] = {}


def input_state(spark: SparkSession, sf_dir: str) -> tuple:
    """Identifies the application and the state of the input tables (size,
    files and time of change): what is kept for one is not used for another."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for t in ("lineitem", "orders", "part", "customer", "nation", "region"):
        path = jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, t))
        fs = path.getFileSystem(conf)
        summary = fs.getContentSummary(path)
        out.append((summary.getLength(), summary.getFileCount(), fs.getFileStatus(path).getModificationTime()))
    return spark.sparkContext.applicationId, sf_dir.rstrip("/"), tuple(out)


FIRST_PURCHASES = {"is_new_brand": ["brand_id"], "is_new_category": ["category"]}


def customer_facts(spark: SparkSession, sf_dir: str) -> CustomerFacts:
    """The canonical order lines, written once per application and state of the
    inputs into the shared checkpoint folder, partitioned by order month and
    bucketed by customer (``sources.customers``).  Besides the line columns they
    carry ``order_sequence`` and the first-purchase flags ``is_new_brand`` /
    ``is_new_category``.

    The four-way join (and the order numbering) then runs once instead of once
    per analysis; a date window reads only its months: every analysis filters
    ``order_month`` next to ``order_date`` (see ``valid_line``), which prunes
    partitions; a step per customer needs no shuffle; and files are sorted by
    brand, so an analysis of one brand skips the other row groups.  The joined lines
    cross the network once more, by customer; the flags, which need the whole
    history of a customer, ride along as windows.  Writes go through Spark's
    commit protocol, so a lost executor only re-runs its tasks; the written
    table also cuts the lineage of everything that reads it.
    """
    key = input_state(spark, sf_dir)
    if key not in _FACTS:
        joined = written(joined_lines(spark, sf_dir, with_sequence=True), "joined-lines")
        _FACTS[key] = write_customer_facts(
            spark, joined, lambda lines: with_derived_columns(first_purchase_windows(with_nations(lines, sf_dir))),
            lambda hot: with_derived_columns(with_first_purchase_flags(with_nations(hot, sf_dir), FIRST_PURCHASES)),
            cluster=["brand_id"], bloom=["product_id"],
        )
    return _FACTS[key]


def fact_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of ``customer_facts``."""
    return customer_facts(spark, sf_dir).lines()


def first_purchase_windows(lines: DataFrame) -> DataFrame:
    """``with_first_purchase_flags`` for lines distributed by customer: windows
    over (customer, brand) and (customer, category), without a shuffle.  A NULL
    key has no first purchase, as in the join."""
    day = F.col("order_date")
    flags = {}
    for name, by in FIRST_PURCHASES.items():
        keys = ["customer_id", *by]
        known = F.lit(True)
        for k in keys:
            known = known & F.col(k).isNotNull()
        flags[name] = F.coalesce(known & (day == first_of(valid_base_filter(), day, keys)), F.lit(False))
    return lines.withColumns(flags)


def with_line_measures(tx: DataFrame) -> DataFrame:
    """Revenue/cost measures used by the KPI and bundle analyses (all DECIMAL).

    rrp = units x retail price; net = gross x (1 - tax); shipping = gross x tax;
    cogs = 0.60 x list; gp = net - cogs; funding = 0.50 x discount.
    """
    return (
        tx.withColumn("rrp_revenue", (F.col("units") * F.col("retail_price")).cast("decimal(22,2)"))
        .withColumn("net_revenue", (F.col("gross_revenue") * (1 - F.col("tax_rate"))).cast("decimal(24,6)"))
        .withColumn("shipping_revenue", (F.col("gross_revenue") * F.col("tax_rate")).cast("decimal(24,6)"))
        .withColumn("cogs", (F.col("list_revenue") * F.lit(0.60).cast(RATE)).cast("decimal(22,4)"))
        .withColumn("gp", (F.col("net_revenue") - F.col("cogs")).cast("decimal(24,6)"))
        .withColumn("funding", (F.col("discount") * F.lit(0.50).cast(RATE)).cast("decimal(24,6)"))
    )


def valid_base_filter() -> Column:
    """Lines that count as a real purchase in the derived first-purchase flags."""
    return (
        (F.col("units") > 0)
        & (F.col("payment_status") == "Paid")
        & ~F.col("is_gift")
        & ~F.col("country_group").isin("AMERICA", "ASIA")
    )


def with_first_purchase_flags(tx: DataFrame, flags: dict[str, list[str]]) -> DataFrame:
    """For each ``out -> by``: ``out`` = order_date is the customer's first
    valid purchase date for ``by``.

    Each first date is a grouped MIN over the valid lines (combined map-side),
    written and joined back on its keys, so that the lines of a hot customer
    can be split (plans.written).  Used for the hot part of the facts.
    """
    out = tx
    for name, by in flags.items():
        keys = ["customer_id", *by]
        first = tx.filter(valid_base_filter()).groupBy(*keys).agg(F.min("order_date").alias("_first_date"))
        out = (
            out.join(written(first, "first-purchases"), keys, "left")
            .withColumn(name, F.coalesce(F.col("order_date") == F.col("_first_date"), F.lit(False)))
            .drop("_first_date")
        )
    return out


# ---------------------------------------------------------------------------
# Dimensions derived from part
# ---------------------------------------------------------------------------


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("product_id"),
        (F.col("p_partkey") + PRODUCT_KEY_OFFSET).alias("product_key"),
        F.col("p_name").alias("product_title"),
        F.col("p_type").alias("category"),
        brand_id_of(F.col("p_brand")).alias("brand_id"),
        F.col("p_brand").alias("brand_name"),
    )


def product_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with a size and unit in the title: ``name size unit``; every
    11th product has no number."""
    part = read_table(spark, sf_dir, "part")
    unit = F.element_at(F.array(*[F.lit(u) for u in TITLE_UNITS]), (F.col("p_partkey") % 7 + 1).cast("int"))
    title = F.when(F.col("p_partkey") % 11 == 0, F.col("p_name")).otherwise(
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), unit)
    )
    return part.select(F.col("p_partkey").alias("product_id"), title.alias("product_title"))


def product_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"))


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per brand: brand_id, brand_name (grouped from part)."""
    part = read_table(spark, sf_dir, "part")
    return part.groupBy(brand_id_of(F.col("p_brand")).alias("brand_id")).agg(F.min("p_brand").alias("brand_name"))


def brand_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """brand_id, brand_submarket, main_category (the category of the brand's first part by
    name of its lowest part key).  Brands in BRANDS_WITHOUT_METADATA are left out to test misses."""
    part = read_table(spark, sf_dir, "part")
    submarket = F.element_at(F.array(*[F.lit(s) for s in SUBMARKETS]), (F.col("brand_id") % 5 + 1).cast("int"))
    return (
        part.groupBy(brand_id_of(F.col("p_brand")).alias("brand_id"))
        .agg(F.min_by("p_type", "p_partkey").alias("main_category"))
        .filter(~F.col("brand_id").isin(*BRANDS_WITHOUT_METADATA))
        .select("brand_id", submarket.alias("brand_submarket"), "main_category")
    )


def brand_fixes(spark: SparkSession) -> DataFrame:
    """The brand-key correction list (a parameter table, a handful of rows)."""
    return spark.createDataFrame(BRAND_FIXES, "wrong_brand_key bigint, correct_brand_key bigint")


def bundles_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundle -> child products.  Bundles are parts with key % 10 = 0 (those with
    key % 50 = 0 stay unmapped); children are key + 1, + 2, + 3 with Qty 1, 2,
    NULL and Cost_Weight '50', '30', 'n/a' (text, to exercise safe casts)."""
    p = products(spark, sf_dir)
    bundle = p.filter((F.col("product_id") % 10 == 0) & (F.col("product_id") % 50 != 0)).select(
        F.col("product_id").alias("Bundle_Product_Id"),
        F.col("product_key").alias("Bundle_Product_Key"),
        F.col("product_title").alias("Bundle_Product_Title"),
        F.col("brand_name").alias("Bundle_Brand_Name"),
        F.col("category").alias("Bundle_Category"),
    )
    slots = F.explode(
        F.array(
            F.struct(F.lit(1).alias("n"), F.lit(1).cast("bigint").alias("Qty"), F.lit("50").alias("Cost_Weight")),
            F.struct(F.lit(2).alias("n"), F.lit(2).cast("bigint").alias("Qty"), F.lit("30").alias("Cost_Weight")),
            F.struct(F.lit(3).alias("n"), F.lit(None).cast("bigint").alias("Qty"), F.lit("n/a").alias("Cost_Weight")),
        )
    ).alias("slot")
    exploded = bundle.select("*", slots).select(
        "*", (F.col("Bundle_Product_Id") + F.col("slot.n")).alias("Child_Product_Id"), "slot.Qty", "slot.Cost_Weight"
    ).drop("slot")
    child = p.select(
        F.col("product_id").alias("Child_Product_Id"),
        F.col("product_title").alias("Child_Product_Title"),
        F.col("brand_name").alias("Child_Brand_Name"),
        F.col("category").alias("Child_Category"),
    )
    return exploded.join(child, "Child_Product_Id", "left")


def customer_product(tx: DataFrame) -> DataFrame:
    """Order lines in the column names of the bundle analysis."""
    m = with_line_measures(tx)
    return m.select(
        F.year("order_date").cast("bigint").alias("Year"),
        F.col("order_date").alias("Order_Date"),
        "order_month",
        F.col("brand_key").alias("Brand_Key"),
        F.col("brand_name").alias("Brand_Name"),
        F.col("category").alias("Category"),
        "product_id",
        F.col("product_key").alias("Product_Key"),
        F.when(F.col("product_id") % 10 == 0, 1).otherwise(0).alias("Is_Bundle"),
        F.col("units").alias("Units"),
        F.col("list_revenue").alias("list_price"),
        F.col("gross_revenue").alias("product_revenue"),
        F.col("net_revenue").alias("product_net_revenue"),
        F.col("rrp_revenue").alias("rrp"),
        F.col("shipping_revenue").alias("Shipping_Net_Revenue"),
        F.col("cogs").alias("product_cost"),
        F.col("discount").alias("Total_Discount"),
        F.col("funding").alias("funded"),
        "gp",
        F.col("business_unit").alias("Business_Unit"),
        F.col("country_group").alias("Country_Group"),
        F.col("is_gift").cast("int").alias("Is_GWP"),
        F.when(F.col("payment_status") == "Paid", 0).otherwise(1).alias("Order_Payment_Status_Key"),
    )


# ---------------------------------------------------------------------------
# Calendar and price lists
# ---------------------------------------------------------------------------


_CALENDARS: dict[tuple, str] = {}


def line_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months of the orders that ``transactions`` has lines of: its joins as
    semi-joins, on keys alone (as there, a NULL key joins nothing)."""
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"))
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(by_shuffle(part), "l_partkey", "left_semi")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", order_month_of(F.col("o_orderdate").cast("date")).alias("order_month"))
    customers = customers_of_nations(spark, sf_dir).select(F.col("c_custkey").alias("o_custkey"))
    known = orders.join(by_shuffle(customers), "o_custkey", "left_semi")
    return known.join(by_shuffle(li.select(F.col("l_orderkey").alias("o_orderkey"))), "o_orderkey", "left_semi").select("order_month")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per day, from a year before the first order month to a year
    after the last one: full_date, date_key (yyyyMMdd), last_year_day_aligned
    (date - 364, same weekday), calendar_year_month (yyyyMM).

    The bounds come from the month partitions of the fact table (only
    partition values are read) if it is written, else from the keys of its
    lines: the price analyses need no facts.  The few thousand rows are written
    once per session to the shared folder, so repeated lookups read a small file.
    """
    key = input_state(spark, sf_dir)
    path = _CALENDARS.get(key)
    if path is None:
        from tillroll.session import shared_dir

        lines = fact_transactions(spark, sf_dir) if key in _FACTS else line_months(spark, sf_dir)
        months = lines.agg(F.min("order_month").alias("lo"), F.max("order_month").alias("hi"))
        first_day = lambda c: F.to_date(F.concat(F.col(c).cast("string"), F.lit("01")), "yyyyMMdd")
        bounds = months.select(
            F.add_months(first_day("lo"), -12).alias("lo"), F.last_day(F.add_months(first_day("hi"), 12)).alias("hi")
        )
        days = bounds.select(F.explode(F.sequence("lo", "hi")).alias("full_date"))
        path = shared_dir(spark, "calendar")
        days.select(
            "full_date",
            F.date_format("full_date", "yyyyMMdd").cast("bigint").alias("date_key"),
            F.date_sub("full_date", 364).alias("last_year_day_aligned"),
            F.date_format("full_date", "yyyyMM").alias("calendar_year_month"),
        ).coalesce(1).write.parquet(path)
        _CALENDARS[key] = path
    return spark.read.parquet(path)


def displayable_skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part on each site (37, 231) and locale (3, 6).  The sku category
    is the lower-cased type, so the product attribution (upper case) visibly
    wins when present."""
    return _placed(products(spark, sf_dir))


def _placed(p: DataFrame, *more: str) -> DataFrame:
    """Rows of ``products`` on each site and locale, with their columns ``more``."""
    placements = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(s).alias("Site_Key"), F.lit(SITE_NAMES[s]).alias("Site"),
                    F.lit(loc).alias("Locale_Key"), F.lit(LOCALES[loc]).alias("Locale"),
                )
                for s in (SITE_CORE, SITE_CULT)
                for loc in LOCALES
            ]
        )
    ).alias("pl")
    return p.select("*", placements).select(
        F.col("product_id").alias("Product_Id"),
        "product_key",
        F.col("product_title").alias("Product_Title"),
        "pl.Site_Key",
        "pl.Site",
        "pl.Locale_Key",
        "pl.Locale",
        F.lower("category").alias("Category"),
        *more,
    )


def product_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id -> Brand_Key."""
    return products(spark, sf_dir).select("product_id", F.col("brand_id").alias("Brand_Key"))


def brand_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand_Key, Brand_Name."""
    return brands(spark, sf_dir).select(F.col("brand_id").alias("Brand_Key"), F.col("brand_name").alias("Brand_Name"))


def product_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id, Category, Subcategory ('SIZE_' + size % 4); parts with key
    % 19 = 0 have no attribution (the sku's own category is used)."""
    part = read_table(spark, sf_dir, "part")
    return part.filter(F.col("p_partkey") % 19 != 0).select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("Category"),
        F.concat(F.lit("SIZE_"), (F.col("p_size") % 4).cast("string")).alias("Subcategory"),
    )


def price_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(current, historic) price intervals [Valid_From, Valid_To) per sku.

    Segment k of a part starts at epoch + 30k + partkey % 17 and ends where the
    next starts (the last is open-ended).  RRP is the retail price; the price is
    80% of it when (7 * partkey + 3k) % 5 < 2.  Locale 3 is priced in currency
    2, others in currency 1.  Parts with key % 13 = 0 have no price.

    Parts meet their retail price before they are placed and cut into segments.
    """
    part = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_retailprice").cast(MONEY).alias("RRP")
    )
    priced = products(spark, sf_dir).filter(F.col("product_id") % 13 != 0).join(by_shuffle(part), "product_id")
    k = F.explode(F.sequence(F.lit(0), F.lit(PRICE_SEGMENTS - 1))).alias("k")
    seg = _placed(priced, "RRP").select("*", k)
    start = lambda kk: F.date_add(F.lit(PRICE_EPOCH).cast("date"), (kk * PRICE_SEGMENT_DAYS + F.col("Product_Id") % 17).cast("int"))
    discounted = (7 * F.col("Product_Id") + 3 * F.col("k")) % 5 < 2
    prices = seg.select(
        F.col("product_key").alias("Product_key"),
        "Site_Key",
        "Locale_Key",
        F.when(F.col("Locale_Key") == 3, 2).otherwise(1).alias("Currency_Key"),
        start(F.col("k")).alias("Valid_From"),
        F.when(F.col("k") == PRICE_SEGMENTS - 1, F.lit(OPEN_END).cast("date"))
        .otherwise(start(F.col("k") + 1))
        .alias("Valid_To"),
        "RRP",
        F.when(discounted, (F.col("RRP") * F.lit(0.80).cast(RATE)).cast(MONEY)).otherwise(F.col("RRP")).alias("Price"),
        "k",
    )
    current = prices.filter(F.col("k") >= PRICE_SEGMENTS // 2).drop("k")
    historic = prices.filter(F.col("k") < PRICE_SEGMENTS // 2).drop("k")
    return current, historic


def daily_base(tx: DataFrame) -> DataFrame:
    """Order lines with measures, date key and a first-purchase-in-category
    flag, in the shape of the KPI fact table."""
    m = with_line_measures(tx)
    odd = F.col("product_id") % 2
    return m.select(
        (F.year("order_date") * 10000 + F.month("order_date") * 100 + F.day("order_date")).cast("bigint").alias("date_key"),
        "order_month", "brand_id", "order_date", "order_id", "customer_id",
        F.col("is_new_category").cast("int").alias("new_category"),
        "rrp_revenue", "list_revenue", "gross_revenue", "net_revenue", "shipping_revenue",
        "gp", "cogs", "funding", "discount", "units",
        "business_unit", "country_group", "region", "site", "category", "brand_name",
        F.concat_ws("_", "category", (F.col("product_id") % 4).cast("string")).alias("subcategory"),
        F.concat(F.lit("WH"), (F.col("product_id") % 3).cast("string")).alias("warehouse_name"),
        odd.cast("int").alias("external_reporting_flag"),
        F.col("is_gwp").cast("int").alias("is_gwp"),
        F.concat(F.lit("US_"), "category").alias("us_category"),
        F.concat_ws("_", F.lit("US"), "category", odd.cast("string")).alias("us_subcategory"),
        (F.col("brand_id") % 3 == 0).cast("int").alias("partnership_flag"),
        F.col("region").alias("country_name"),  # an optional dimension of the KPIs
    )


_BRANDS: dict[tuple, str] = {}


def brand_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """brand_id, brand_submarket, brand_category for the KPI table.  Written
    once beside the facts, so that Spark knows its true size when it plans the
    join with the lines."""
    key = input_state(spark, sf_dir)
    if key not in _BRANDS:
        from tillroll.session import shared_dir

        _BRANDS[key] = shared_dir(spark, "brand-attribution")
        brand_metadata(spark, sf_dir).select(
            "brand_id", "brand_submarket", F.col("main_category").alias("brand_category")
        ).coalesce(1).write.parquet(_BRANDS[key])
    return spark.read.parquet(_BRANDS[key])
