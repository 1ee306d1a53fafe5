"""What the plans must not do: read columns nobody needs, scan lines twice."""

import itertools
import re

from tillroll import registry
from tillroll.sources import canonical as canon

SF = "/root/testdata/sf0.001"


def scans(df) -> list[str]:
    return re.findall(r"ReadSchema: (struct<[^\n]*)", df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))


def test_active_elsewhere_reads_its_columns_only(spark):
    used = [s for s in scans(registry.QUERIES["active_elsewhere"](spark, SF)) if "order_date" in s]
    assert used and all("list_revenue" not in s and "product_title" not in s for s in used)


def test_lines_are_scanned_once_for_the_facts(spark):
    found = [s for s in scans(canon.transactions(spark, SF, with_sequence=True)) if "l_orderkey" in s]
    assert len(found) == 1 and "l_shipmode" not in found[0] and "l_comment" not in found[0]


def test_pairs_cross_the_network_once(spark):
    plan = registry.QUERIES["basket_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    keyed = [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) if "co_product_id" in x and "target_product_id" in x]
    assert len(keyed) <= 2 and "order_number" not in "".join(keyed) and plan.count("Expand") == 0


def test_kpis_do_not_multiply_lines(spark):
    plan = registry.QUERIES["monthly_kpi"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def broadcast_keys(df) -> set[str]:
    """The left keys of all broadcast joins of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {re.sub(r"#.*", "", k.strip()) for keys in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan) for k in keys.split(",")}


def test_prices_broadcast_no_part_and_no_sku(spark):
    """Small tables stand for inputs that Spark sizes too low: parts, skus,
    customers and lines are never collected on the driver."""
    small = {"Brand_Key", "_eff_key", "correct_brand_key", "Date", "c_nationkey", "n_regionkey"}
    for prices in canon.price_lists(spark, SF):
        assert broadcast_keys(prices) == set()
    assert broadcast_keys(canon.line_months(spark, SF)) <= small
    assert broadcast_keys(registry._price_run(spark, SF, registry.PRICE_WINDOWS[0], 4)) <= small
    current, _ = canon.price_lists(spark, SF)
    grid = registry.prc.sku_date_grid(*registry._sku_inputs(spark, SF), canon.calendar(spark, SF), current, registry.PRICE_WINDOWS[0])
    assert broadcast_keys(grid) <= small


def below(plan: str, line: str) -> str:
    """What a line of a plan stands on: the lines after it that are set deeper."""
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    lines = plan.splitlines()
    at = lines.index(line)
    return "\n".join(itertools.takewhile(lambda x: depth(x) > depth(line), lines[at + 1 :]))


def test_products_meet_their_brands_before_they_are_placed(spark):
    """Brands and attributes are joined to a row per product, not per sku."""
    skus = registry.prc.displayed_skus(*registry._sku_inputs(spark, SF), canon.price_lists(spark, SF)[0])
    plan = skus._jdf.queryExecution().executedPlan().toString()
    branded = [x for x in plan.splitlines() if re.search(r"Join \[(Brand_Key|_eff_key)#", x)]
    assert len(branded) == 3 and not any("explode" in below(plan, x) for x in branded)


def test_checkpoint_folder_is_asked_for_off_local_mode(spark, monkeypatch):
    import pytest

    from tillroll import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

    monkeypatch.setattr(session, "_context", lambda s: Context())
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())
