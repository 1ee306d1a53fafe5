"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

One warm-up run of each query, then the median of $BENCH_REPS timed runs;
results are fully consumed with the ``noop`` sink.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillroll.registry import QUERIES, campaign_summaries, daily_price_table  # noqa: E402
from tillroll.sources import canonical as canon  # noqa: E402
from tillroll.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cores=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    times = {}
    # One-time per session: the partitioned fact table and the calendar that
    # every analysis reads (counted once, not per query).
    t = time.perf_counter()
    canon.fact_transactions(spark, sf_dir)
    canon.calendar(spark, sf_dir)
    times["_materialize_facts"] = round(time.perf_counter() - t, 3)
    # The three reloads of the daily price table, read by its own query and
    # by the campaign queries.
    t = time.perf_counter()
    incremental = {"campaign_islands_incremental", "campaign_compliance_incremental"}
    if not only or incremental & set(only) or {"daily_prices_table", "campaign_islands_sliced", "campaign_islands", "discount_days_brand", "discount_days_category", "campaign_compliance", "compliance_table"} & set(only):
        daily_price_table(spark, sf_dir)
    times["_reload_daily_prices"] = round(time.perf_counter() - t, 3)
    # The campaign summaries, brought up to date after each of the three reloads.
    t = time.perf_counter()
    if not only or incremental & set(only):
        campaign_summaries(spark, sf_dir)
    times["_refresh_campaign_summaries"] = round(time.perf_counter() - t, 3)
    for name, q in QUERIES.items():
        if only and name not in only:
            continue
        q(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        runs = []
        for _ in range(reps):
            t = time.perf_counter()
            q(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_median_sec_all_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                "cpus": cpus,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
