"""The customer layout: same rows as without it, no shuffle by customer, and a
customer with a third of all lines apart from the buckets."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tests.frames import D, line, tx
from tillroll import registry
from tillroll.functions.windows import Window
from tillroll.operators import category_mix as mix
from tillroll.operators import frequency as freq
from tillroll.operators import luxury_entry as lux
from tillroll.operators import reorder as reo
from tillroll.operators import retention as ret
from tillroll.operators import top_products as top
from tillroll.sources import canonical as canon
from tillroll.sources.customers import HOT_ROWS, CustomerFacts, lines_of, per_customer, split_hot, write_customer_facts

SF = "/root/testdata/sf0.001"
W = Window(D(1999, 1, 1), D(2001, 12, 31))
OPTS = dict(excluded_countries=["US"])


@pytest.fixture(scope="module")
def lines(spark):
    """300 customers, one of them with a third of all lines, and lines without a customer."""
    rows = []
    for i in range(1500):
        c = 7 if i % 3 == 0 else None if i % 41 == 0 else i % 300 + 100
        rows.append(line(c, 10_000 + i // 2, D(1999 + i % 3, 1 + i % 12, 1 + i % 28), brand=1 + i % 3, category=["Hair", "Skin", "Body"][i % 3], product=i % 9, new=i % 4 == 0))
    # an order has one customer
    rows = [(r[0], r[0] * 100_000 + r[1] % 700 if r[0] else r[1], *r[2:]) for r in rows]
    return tx(spark, rows)


@pytest.fixture(scope="module")
def facts(spark, lines):
    return write_customer_facts(spark, lines, hot_rows=100, bucket_rows=100)


def rows(df):
    return sorted(str(sorted(r.asDict().items())) for r in df.collect())


def test_hot_customers_are_apart_and_no_line_is_lost(spark, lines, facts):
    assert {r[0] for r in facts.hot.select("customer_id").distinct().collect()} == {7}
    assert facts.regular.where("customer_id = 7").count() == 0
    assert rows(facts.lines()) == rows(lines)
    per_task = facts.hot.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert facts.hot.count() == 500 and per_task < 500  # split by month files


def test_null_is_a_customer_like_any_other(spark, lines):
    only = lines.where("customer_id is null")
    regular, hot, n = split_hot(only, hot_rows=only.count() - 1)
    assert regular.count() == 0 and hot.count() == only.count() and n == 0
    assert split_hot(only, hot_rows=only.count())[1] is None


STEPS = {
    "frequency": lambda t: freq.order_frequency(t, W, [1, 2], "Hair", site_id=37, **OPTS),
    "year_orders": lambda t: freq.customer_year_orders(t, W, [1, 2], "Hair", site_id=37, **OPTS),
    "types": lambda t: freq.customer_types_by_year(t, W, [1, 2], "Hair", site_id=37, **OPTS),
    "retention": lambda t: ret.retention_cohorts(t, 1, 1999, **OPTS),
    "mix": lambda t: mix.category_mix(t, W, [1, 2, 3], **OPTS),
    "recency": lambda t: reo.customer_recency(t, W, 1, **OPTS),
    "gaps": lambda t: reo.order_gaps(t, W, 1, **OPTS),
    "interval": lambda t: reo.reorder_interval(t, W, 1, **OPTS),
    "activity": lambda t: reo.brand_activity(t, W, 1, "Skin", **OPTS),
    "entry": lambda t: lux.entry_event(lux.base_orders(t, W, **OPTS), [2], "Skin"),
    "offsets": lambda t: lux.customer_order_offsets(lux.base_orders(t, W, **OPTS), [2], "Skin").withColumn("brand_ids", F.array_sort("brand_ids")),
    "products": lambda t: top.product_measures(t, F.col("customer_id").isNotNull()),
}


@pytest.mark.parametrize("step", STEPS)
def test_same_rows_with_and_without_the_layout(lines, facts, step):
    got, want = rows(STEPS[step](facts)), rows(STEPS[step](lines))
    assert got == want and want


def test_offsets_equal_the_split_plan(lines):
    base = lux.base_orders(lines, W, **OPTS)
    want = lux.order_offsets(base, lux.entry_event(base, [2], "Skin"))
    got = lux.customer_order_offsets(CustomerFacts(base, None), [2], "Skin")
    keep = ["customer_id", "order_id", "order_date", "order_sequence", "order_year", "order_from_lux"]
    assert rows(got.select(*keep)) == rows(want.select(*keep))


NO_CUSTOMER_EXCHANGE = [
    "customer_recency", "order_gaps", "reorder_interval", "retention_cohorts", "entry_event", "order_offsets",
    "order_category_flags", "customer_year_orders", "order_frequency", "kpi_preaggregate", "monthly_kpi", "top_products_new",
]


@pytest.mark.parametrize("name", NO_CUSTOMER_EXCHANGE)
def test_no_shuffle_by_customer(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"Exchange hashpartitioning\([^)]*customer_id", plan)
    assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan


def test_the_facts_of_the_given_tables_have_no_hot_customer(spark):
    facts = canon.customer_facts(spark, SF)
    assert facts.hot is None and HOT_ROWS < 10_000_000
    n = facts.lines().count()
    assert n == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert per_customer(facts, lambda df: df).count() == lines_of(facts).count() == n


def test_flags_by_window_equal_flags_by_join(spark):
    joined = canon.transactions(spark, SF)
    by_join = canon.with_first_purchase_flags(joined, canon.FIRST_PURCHASES)
    by_window = canon.first_purchase_windows(joined)
    keep = ["order_id", "product_id", "units", "list_revenue", "is_new_brand", "is_new_category"]
    assert rows(by_window.select(*keep)) == rows(by_join.select(*keep))


def test_kpi_crosses_the_network_once(spark):
    plan = registry.QUERIES["kpi_preaggregate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_input_state_follows_the_files(spark, tmp_path):
    import shutil

    for t in ("lineitem", "orders", "part", "customer", "nation", "region"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    first = canon.input_state(spark, str(tmp_path))
    assert first == canon.input_state(spark, str(tmp_path) + "/")
    spark.read.parquet(f"{SF}/part.parquet").limit(3).coalesce(1).write.parquet(str(tmp_path / "new"))
    new = next((tmp_path / "new").glob("part-*.parquet"))
    shutil.copy(new, tmp_path / "part.parquet")
    assert canon.input_state(spark, str(tmp_path)) != first


def scanned_rows(df):
    """Rows that the scan handed on (row groups that statistics or Bloom filters did not skip)."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("cluster,bloom", [([], []), (["brand_id"], ["product_id"])])
def test_one_brand_reads_few_row_groups(spark, cluster, bloom):
    lines = spark.range(200_000).select(
        (F.col("id") % 1000).alias("customer_id"), (F.xxhash64("id") % 25).alias("brand_id"), (F.xxhash64("id", F.lit(1)) % 100_000 * 2).alias("product_id"), F.lit(200001).alias("order_month"), "id"
    )
    small = {"parquet.block.size": "16384", "parquet.page.size": "4096", "parquet.page.row.count.limit": "1000", "parquet.block.size.row.check.min": "1"}
    facts = write_customer_facts(spark, lines, bucket_rows=50_000, cluster=cluster, bloom=bloom, options=small)
    df = facts.lines()
    brand = scanned_rows(df.where("brand_id = 7").select("id"))
    assert df.where("brand_id = 7").count() == lines.where("brand_id = 7").count()
    assert (brand < 60_000) == bool(cluster)


def test_buckets_and_bloom_filters_follow_the_lines(spark):
    """A task sorts a bucket's lines: under a million of them; a filter is as
    large as its file's values need, not 1 MB a file."""
    from tillroll.sources.customers import BUCKET_ROWS

    assert BUCKET_ROWS <= 1_000_000 and HOT_ROWS <= 1_000_000
    lines = spark.range(3000).select((F.col("id") % 50).alias("customer_id"), F.lit(200001).alias("order_month"), "id")
    facts = write_customer_facts(spark, lines, bucket_rows=1000, bloom=["id"])
    sizes = [os.path.getsize(f.removeprefix("file://")) for f in facts.regular.inputFiles()]
    assert len(sizes) >= 3 and max(sizes) < 100_000


def test_joined_lines_carry_no_derived_columns(spark):
    narrow, whole = canon.joined_lines(spark, SF), canon.transactions(spark, SF)
    assert len(narrow.columns) == 18 and whole.columns == canon.LINE_COLUMNS
    assert narrow.count() == whole.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
