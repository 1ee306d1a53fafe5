"""Registered queries: one per analysis and per useful stage.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the analysis on the given
tables with fixed parameters; ``ORACLE[name]`` (from ``tillroll.oracle``) is
the DuckDB SQL that must give the same rows.  Parameters follow FIXTURES.md
section 4 so that every result is non-trivial on the test data.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll import oracle
from tillroll.functions import windows as win
from tillroll.operators import basket as bsk
from tillroll.operators import bundles as bun
from tillroll.operators import campaign_runs as runs
from tillroll.operators import category_mix as mix
from tillroll.operators import distinct_customers as dis
from tillroll.operators import frequency as freq
from tillroll.operators import history as hist
from tillroll.operators import kpi
from tillroll.operators import luxury_entry as lux
from tillroll.operators import pricing as prc
from tillroll.operators import reorder as reo
from tillroll.operators import retention as ret
from tillroll.operators import titles as ttl
from tillroll.operators import top_products as top
from tillroll.plans.written import written
from tillroll.session import shared_dir
from tillroll.sources import canonical as canon
from tillroll.sources import snapshots

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = oracle.SQL


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return deco


# ---------------------------------------------------------------------------
# Parameters (fixed values for the registered runs)
# ---------------------------------------------------------------------------
EXCLUDED = ("AMERICA", "ASIA")
CORE_UNIT = "BUILDING"  # stands for the scripts' business unit
SITE = 37
LUX_BRANDS = list(range(1, 16))
LUX_CATEGORY = "PROMO"
AS_OF = dt.date(2001, 7, 15)
MIX_AS_OF = dt.date(2000, 12, 31)
MIX_CATEGORIES = {"Hair": "LARGE", "Cosmetics": "SMALL", "Skin": "MEDIUM", "Fragrance": "STANDARD", "Body": "ECONOMY"}
RETENTION_BRAND, RETENTION_START = 16, 1997
ACTIVITY_BRAND, ACTIVITY_CATEGORY = 4, "PROMO"
REORDER_BRAND = 16
TOP_BRAND = 4
BASKET_BRANDS = [1, 2, 3, 4]
ENTRY_BRANDS = [3, 8, 13, 18, 23]
BUNDLE_UNITS_ANY = ["AUTOMOBILE", "BUILDING"]
BUNDLE_UNIT_RESTRICTED = "MACHINERY"
TITLE_CATEGORY = "LARGE"
KPI_RELOADS = [dt.date(2001, 6, 10), dt.date(2001, 7, 15)]
# Three reloads: the second overlaps the first (its days are replaced), the
# third sees current prices that have already ended (NULL rows marked 'H').
PRICE_RELOADS = [dt.date(2000, 7, 15), dt.date(2000, 7, 28), dt.date(2000, 8, 10)]

YEAR_BEFORE = win.previous_calendar_year(AS_OF)
THREE_YEARS = win.calendar_years_back(AS_OF, 3, 1)
YEAR_SO_FAR = win.year_to_date(MIX_AS_OF)
LAST_YEAR = win.trailing_year(AS_OF)
THIS_YEAR = win.year_to_yesterday(AS_OF)
PRICE_WINDOWS = [win.last_days(a, 16) for a in PRICE_RELOADS]
LAST_MONTH = win.Window(LAST_YEAR.end.replace(day=1), LAST_YEAR.end)
TWO_YEARS = win.Window(dt.date(1999, 7, 1), dt.date(2001, 6, 30))
KPI_COUNTRY_DIMS = ["country_name", "category", "brand_name"]
PRICE_LOCALE, PRICE_CURRENCY = 6, 1

_tx = canon.fact_transactions  # all lines
_facts = canon.customer_facts  # the same lines by customer: steps per customer need no shuffle


# ---------------------------------------------------------------------------
# Order frequency, buyer types
# ---------------------------------------------------------------------------
@register("order_frequency")
def q_order_frequency(spark, sf_dir):
    return freq.order_frequency(_facts(spark, sf_dir), YEAR_BEFORE, LUX_BRANDS, LUX_CATEGORY, excluded_countries=EXCLUDED, site_id=None)


@register("order_frequency_site")
def q_order_frequency_site(spark, sf_dir):
    return freq.order_frequency(_facts(spark, sf_dir), YEAR_BEFORE, LUX_BRANDS, LUX_CATEGORY, excluded_countries=EXCLUDED, site_id=SITE)


@register("qualified_orders")
def q_qualified_orders(spark, sf_dir):
    return freq.qualified_orders(_facts(spark, sf_dir), YEAR_BEFORE, LUX_BRANDS, excluded_countries=EXCLUDED, site_id=SITE)


@register("customer_year_orders")
def q_customer_year_orders(spark, sf_dir):
    return freq.customer_year_orders(_facts(spark, sf_dir), THREE_YEARS, LUX_BRANDS, LUX_CATEGORY, excluded_countries=EXCLUDED, site_id=SITE)


@register("customer_types_by_year")
def q_customer_types_by_year(spark, sf_dir):
    return freq.customer_types_by_year(_facts(spark, sf_dir), THREE_YEARS, LUX_BRANDS, LUX_CATEGORY, excluded_countries=EXCLUDED, site_id=SITE)


# ---------------------------------------------------------------------------
# Category mix, retention
# ---------------------------------------------------------------------------
@register("order_category_flags")
def q_order_category_flags(spark, sf_dir):
    return mix.order_category_flags(_facts(spark, sf_dir), YEAR_SO_FAR, LUX_BRANDS, category_values=MIX_CATEGORIES, excluded_countries=EXCLUDED)


@register("category_mix")
def q_category_mix(spark, sf_dir):
    return mix.category_mix(_facts(spark, sf_dir), YEAR_SO_FAR, LUX_BRANDS, category_values=MIX_CATEGORIES, excluded_countries=EXCLUDED)


def _retention(unit):
    return lambda spark, sf_dir: ret.retention_cohorts(
        _facts(spark, sf_dir), RETENTION_BRAND, RETENTION_START, business_unit=unit, excluded_countries=EXCLUDED
    )


register("retention_cohorts")(_retention(None))
register("retention_cohorts_core")(_retention(CORE_UNIT))

# ---------------------------------------------------------------------------
# Reorder interval, brand activity
# ---------------------------------------------------------------------------
_ALL = dict(business_unit=None, excluded_countries=EXCLUDED)
_CORE = dict(business_unit=CORE_UNIT, excluded_countries=EXCLUDED)


@register("customer_recency")
def q_customer_recency(spark, sf_dir):
    return reo.customer_recency(_facts(spark, sf_dir), LAST_YEAR, ACTIVITY_BRAND, None, **_ALL)


@register("order_gaps")
def q_order_gaps(spark, sf_dir):
    return reo.order_gaps(_facts(spark, sf_dir), LAST_YEAR, ACTIVITY_BRAND, None, **_ALL)


@register("reorder_interval")
def q_reorder_interval(spark, sf_dir):
    return reo.reorder_interval(_facts(spark, sf_dir), LAST_YEAR, REORDER_BRAND, None, **_ALL)


@register("reorder_interval_core")
def q_reorder_interval_core(spark, sf_dir):
    return reo.reorder_interval(_facts(spark, sf_dir), LAST_YEAR, REORDER_BRAND, None, **_CORE)


@register("reorder_interval_category")
def q_reorder_interval_category(spark, sf_dir):
    return reo.reorder_interval(_facts(spark, sf_dir), LAST_YEAR, REORDER_BRAND, LUX_CATEGORY, **_ALL)


def _stats(tx):
    rhythm = written(reo.customer_rhythm(tx, LAST_YEAR, ACTIVITY_BRAND, None, **_ALL), "customer-rhythm")
    return reo.recency_of(rhythm, LAST_YEAR), reo.rhythm_stats(rhythm)


@register("activity_gap_bounds")
def q_activity_gap_bounds(spark, sf_dir):
    bounds = reo.gap_bounds(_stats(_facts(spark, sf_dir))[1])
    return bounds.select(*[F.round(c, 6).alias(c) for c in bounds.columns])


@register("activity_buckets")
def q_activity_buckets(spark, sf_dir):
    return reo.activity_buckets(*_stats(_facts(spark, sf_dir)))


@register("activity_buckets_fallback")
def q_activity_buckets_fallback(spark, sf_dir):
    """A month: with no repeat purchase there are no bounds, and customers
    get the fallback label."""
    rhythm = reo.customer_rhythm(_facts(spark, sf_dir), LAST_MONTH, ACTIVITY_BRAND, None, **_ALL)
    return reo.activity_buckets(reo.recency_of(rhythm, LAST_MONTH), reo.rhythm_stats(rhythm))


@register("active_elsewhere")
def q_active_elsewhere(spark, sf_dir):
    tx = _facts(spark, sf_dir)
    return reo.active_elsewhere(tx, reo.activity_buckets(*_stats(tx)), LAST_YEAR, ACTIVITY_BRAND, **_ALL)


@register("brand_activity")
def q_brand_activity(spark, sf_dir):
    return reo.brand_activity(_facts(spark, sf_dir), LAST_YEAR, ACTIVITY_BRAND, ACTIVITY_CATEGORY, **_ALL)


@register("brand_activity_core")
def q_brand_activity_core(spark, sf_dir):
    return reo.brand_activity(_facts(spark, sf_dir), LAST_YEAR, ACTIVITY_BRAND, ACTIVITY_CATEGORY, **_CORE)


# ---------------------------------------------------------------------------
# Top products, baskets
# ---------------------------------------------------------------------------
def _top(is_new: bool, rank_col: str):
    return lambda spark, sf_dir: top.top_products(
        _facts(spark, sf_dir), canon.products(spark, sf_dir), LAST_YEAR, TOP_BRAND, None, is_new, rank_col=rank_col, **_ALL
    )


def _face_off(category, opts):
    return lambda spark, sf_dir: top.top_products_new_vs_returning(
        _facts(spark, sf_dir), canon.products(spark, sf_dir), LAST_YEAR, TOP_BRAND, category, **opts
    )


register("top_products_new")(_top(True, "rank_ntb"))
register("top_products_returning")(_top(False, "rank_rtb"))
register("top_products_face_off")(_face_off(None, _ALL))
register("top_products_face_off_core")(_face_off(None, _CORE))
register("top_products_face_off_category")(_face_off(LUX_CATEGORY, _ALL))


@register("basket_pairs")
def q_basket_pairs(spark, sf_dir):
    return bsk.basket_pairs(_tx(spark, sf_dir), canon.products(spark, sf_dir), THIS_YEAR, BASKET_BRANDS)


@register("basket_cross_sell")
def q_basket_cross_sell(spark, sf_dir):
    return bsk.basket_cross_sell(_tx(spark, sf_dir), canon.products(spark, sf_dir), THIS_YEAR, BASKET_BRANDS)


@register("basket_cross_sell_bounded")
def q_basket_cross_sell_bounded(spark, sf_dir):
    return bsk.basket_cross_sell_bounded(_tx(spark, sf_dir), canon.products(spark, sf_dir), THIS_YEAR, BASKET_BRANDS)


# ---------------------------------------------------------------------------
# Orders around the first luxury order
# ---------------------------------------------------------------------------
def _entry_base(spark, sf_dir):
    return lux.base_orders(_facts(spark, sf_dir), THREE_YEARS, site_id=None, excluded_countries=EXCLUDED)


@register("entry_event")
def q_entry_event(spark, sf_dir):
    return lux.entry_event(_entry_base(spark, sf_dir), ENTRY_BRANDS, LUX_CATEGORY)


def _offsets(spark, sf_dir):
    return lux.customer_order_offsets(_entry_base(spark, sf_dir), ENTRY_BRANDS, LUX_CATEGORY)


@register("order_offsets")
def q_order_offsets(spark, sf_dir):
    return _offsets(spark, sf_dir).drop("brand_ids")


@register("order_submarket_counts")
def q_order_submarket_counts(spark, sf_dir):
    return lux.order_submarket_counts(_offsets(spark, sf_dir), canon.brand_attribution(spark, sf_dir)).drop("na")


def _around_entry(site_id):
    return lambda spark, sf_dir: lux.orders_around_entry(
        _facts(spark, sf_dir), canon.brand_attribution(spark, sf_dir), THREE_YEARS, ENTRY_BRANDS, LUX_CATEGORY, site_id=site_id, excluded_countries=EXCLUDED
    )


register("orders_around_entry")(_around_entry(None))
register("orders_around_entry_site")(_around_entry(SITE))


# ---------------------------------------------------------------------------
# Bundles, titles
# ---------------------------------------------------------------------------
@register("brand_key_fix")
def q_brand_key_fix(spark, sf_dir):
    return bun.brand_key_fix(canon.brand_fixes(spark), canon.brands(spark, sf_dir))


@register("bundle_revenue")
def q_bundle_revenue(spark, sf_dir):
    current, prior = win.trailing_year(AS_OF), win.prior_trailing_year(AS_OF)
    flt = bun.bundle_line_filter(current, prior, BUNDLE_UNITS_ANY, BUNDLE_UNIT_RESTRICTED, list(EXCLUDED))
    return bun.bundle_revenue(
        canon.customer_product(_tx(spark, sf_dir)), canon.products(spark, sf_dir), canon.bundles_mapping(spark, sf_dir), q_brand_key_fix(spark, sf_dir), flt
    )


@register("title_volume_unit")
def q_title_volume_unit(spark, sf_dir):
    return ttl.title_volume_unit(canon.product_titles(spark, sf_dir), canon.product_attributes(spark, sf_dir), TITLE_CATEGORY)


@register("title_volume_unit_strict")
def q_title_volume_unit_strict(spark, sf_dir):
    return ttl.title_volume_unit(canon.product_titles(spark, sf_dir), canon.product_attributes(spark, sf_dir), TITLE_CATEGORY, strict=True)


# ---------------------------------------------------------------------------
# Histories, ranks and prices at the time of sale
# ---------------------------------------------------------------------------
@register("brand_order_history")
def q_brand_order_history(spark, sf_dir):
    return hist.brand_order_history(_facts(spark, sf_dir), LAST_YEAR, excluded_countries=EXCLUDED)


@register("product_ranks")
def q_product_ranks(spark, sf_dir):
    return hist.product_ranks(_facts(spark, sf_dir), LAST_YEAR, is_new=True, excluded_countries=EXCLUDED)


@register("prices_at_sale")
def q_prices_at_sale(spark, sf_dir):
    current, historic = canon.price_lists(spark, sf_dir)
    return _as_double(
        hist.prices_at_sale(
            _facts(spark, sf_dir), current.unionByName(historic), TWO_YEARS, locale=PRICE_LOCALE, currency=PRICE_CURRENCY, excluded_countries=EXCLUDED
        )
    )


# ---------------------------------------------------------------------------
# Monthly KPIs (and two reloads into a partitioned table)
# ---------------------------------------------------------------------------
def _kpi_inputs(spark, sf_dir):
    return _facts(spark, sf_dir).map(canon.daily_base), canon.calendar(spark, sf_dir), canon.brand_attribution(spark, sf_dir)


@register("period_calendar")
def q_period_calendar(spark, sf_dir):
    return kpi.period_calendar(spark, canon.calendar(spark, sf_dir), AS_OF)


@register("kpi_preaggregate")
def q_kpi_preaggregate(spark, sf_dir):
    base, calendar, brands = _kpi_inputs(spark, sf_dir)
    pre = kpi.kpi_preaggregate(base, kpi.period_calendar(spark, calendar, AS_OF), brands, kpi.DIMS)
    money = [c for c in kpi.SUM_KPIS if c != "units"]
    return pre.select(*[F.col(c).cast("double") if c in money else F.col(c) for c in pre.columns]).withColumn("units", F.col("units").cast("bigint"))


@register("monthly_kpi")
def q_monthly_kpi(spark, sf_dir):
    return kpi.monthly_kpi(spark, *_kpi_inputs(spark, sf_dir), AS_OF)


@register("monthly_kpi_country")
def q_monthly_kpi_country(spark, sf_dir):
    return kpi.monthly_kpi(spark, *_kpi_inputs(spark, sf_dir), AS_OF, KPI_COUNTRY_DIMS)


CUSTOMER_DIMS = ["country_group", "category"]


@register("kpi_distinct_customers")
def q_kpi_distinct_customers(spark, sf_dir):
    """Customers per month and period, by country group and category, by each,
    and in all: four totals from one set of bitmaps."""
    base, calendar, _ = _kpi_inputs(spark, sf_dir)
    bitmaps = written(dis.customer_bitmaps(base, kpi.period_calendar(spark, calendar, AS_OF), CUSTOMER_DIMS), "customer-bitmaps")
    return dis.customers_by_subsets(bitmaps, CUSTOMER_DIMS, [CUSTOMER_DIMS, ["country_group"], ["category"], []])


@register("monthly_kpi_table")
def q_monthly_kpi_table(spark, sf_dir):
    """The monthly table after two overlapping reloads (the later one replaces
    the shared month)."""
    table = f"monthly_category_brand_agg_{uuid.uuid4().hex[:8]}"
    location = shared_dir(spark, table)
    for as_of in KPI_RELOADS:
        kpi.reload_monthly_kpi(spark, *_kpi_inputs(spark, sf_dir), as_of, table, location, replace=snapshots.replace_partitions)
    return spark.table(table)


# ---------------------------------------------------------------------------
# Daily prices and campaign compliance
# ---------------------------------------------------------------------------
def _sku_inputs(spark, sf_dir):
    return (
        canon.displayable_skus(spark, sf_dir), canon.product_dim(spark, sf_dir), canon.brand_dim(spark, sf_dir), q_brand_key_fix(spark, sf_dir),
        canon.brand_metadata(spark, sf_dir), canon.product_attribution(spark, sf_dir),
    )


def _price_run(spark, sf_dir, window, buckets=None):
    current, historic = canon.price_lists(spark, sf_dir)
    skus = prc.displayed_skus(*_sku_inputs(spark, sf_dir), current)
    return prc.daily_prices_by_sku(skus, canon.calendar(spark, sf_dir), current, historic, window, buckets)


def _as_double(df):
    return df.select(*[F.col(c).cast("double") if c in ("RRP", "Price") else F.col(c) for c in df.columns])


def _daily_buckets(spark, sf_dir) -> int:
    return prc.daily_buckets(spark, canon.displayable_skus(spark, sf_dir).count(), PRICE_WINDOWS[0])


_DAILY_TABLES: dict[tuple, str] = {}


def daily_price_table(spark, sf_dir) -> DataFrame:
    """The date-partitioned daily price table after the three reloads (built
    once per application and state of the inputs); each reload is a version
    that readers see in one step."""
    key = canon.input_state(spark, sf_dir)
    table = _DAILY_TABLES.get(key)
    if table is None or not spark.catalog.tableExists(table):
        table = f"base_table_{uuid.uuid4().hex[:8]}"
        location = shared_dir(spark, table)
        n = _daily_buckets(spark, sf_dir)
        layout = dict(distributed=True, sort_by=prc.SKU_PART, options={"compression": "zstd"})
        for w in PRICE_WINDOWS:
            prc.refresh_daily_prices(spark, _price_run(spark, sf_dir, w, n), w, table, location, n, snapshots.replace_partitions, **layout)
        _DAILY_TABLES[key] = table
    return spark.table(table)


@register("sku_date_grid")
def q_sku_date_grid(spark, sf_dir):
    current, _ = canon.price_lists(spark, sf_dir)
    grid = prc.sku_date_grid(*_sku_inputs(spark, sf_dir), canon.calendar(spark, sf_dir), current, PRICE_WINDOWS[0])
    return grid.select(*prc.GRID_COLUMNS)


@register("price_at_date")
def q_price_at_date(spark, sf_dir):
    return _as_double(_price_run(spark, sf_dir, PRICE_WINDOWS[0]))


@register("price_at_date_expired")
def q_price_at_date_expired(spark, sf_dir):
    return _as_double(_price_run(spark, sf_dir, PRICE_WINDOWS[2]))


@register("daily_prices_table")
def q_daily_prices_table(spark, sf_dir):
    return _as_double(daily_price_table(spark, sf_dir))


@register("campaign_islands")
def q_campaign_islands(spark, sf_dir):
    return prc.campaign_islands(daily_price_table(spark, sf_dir))


@register("discount_days_brand")
def q_discount_days_brand(spark, sf_dir):
    return prc.discount_days_brand(daily_price_table(spark, sf_dir))


@register("discount_days_category")
def q_discount_days_category(spark, sf_dir):
    return prc.discount_days_category(daily_price_table(spark, sf_dir))


@register("campaign_compliance")
def q_campaign_compliance(spark, sf_dir):
    return prc.campaign_compliance(daily_price_table(spark, sf_dir))


@register("compliance_table")
def q_compliance_table(spark, sf_dir):
    """The compliance table after it was created and replaced once."""
    table = f"compliance_{uuid.uuid4().hex[:8]}"
    location = shared_dir(spark, table)
    rows = prc.campaign_compliance(daily_price_table(spark, sf_dir))
    prc.publish_compliance(spark, rows.filter(F.col("Campaign_Flag") == 1), table, location)
    prc.publish_compliance(spark, rows, table, location)
    return spark.table(table)


# ---------------------------------------------------------------------------
# Campaigns from the run summary, and by sliced windows
# ---------------------------------------------------------------------------
_SUMMARIES: dict[tuple, tuple[str, str]] = {}


def campaign_summaries(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The run and day summaries of the daily table, brought up to date for
    each of the three windows in turn (once per application and state of the
    inputs)."""
    key = canon.input_state(spark, sf_dir)
    if key not in _SUMMARIES:
        tag = uuid.uuid4().hex[:8]
        names = (f"campaign_runs_{tag}", f"campaign_days_{tag}")
        location = shared_dir(spark, "campaign-summaries")
        for w in PRICE_WINDOWS:
            daily = daily_price_table(spark, sf_dir)
            runs.refresh(spark, daily, w, *names, location, _daily_buckets(spark, sf_dir), distributed=True)
        _SUMMARIES[key] = names
    return tuple(spark.table(n) for n in _SUMMARIES[key])


@register("campaign_islands_incremental")
def q_campaign_islands_incremental(spark, sf_dir):
    return runs.islands_of_runs(campaign_summaries(spark, sf_dir)[0])


@register("campaign_compliance_incremental")
def q_campaign_compliance_incremental(spark, sf_dir):
    of_runs, days = campaign_summaries(spark, sf_dir)
    return prc.compliance_of(runs.islands_of_runs(of_runs), days)


@register("campaign_islands_sliced")
def q_campaign_islands_sliced(spark, sf_dir):
    return runs.islands_by_slices(daily_price_table(spark, sf_dir))
