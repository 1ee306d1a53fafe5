"""Shuffle bytes and task time per registered query, from Spark's event log.

    python tools/profile_shuffle.py [sf_dir] [event_log_dir]
    python tools/profile_shuffle.py --parse event_log_dir

Runs each query once (after the one-time fact build) with a job description
equal to its name, then reads the event log and sums, per query, the shuffle
bytes written and the executor run time of its stages.  Prints one JSON line.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _lines(path: str):
    if path.endswith(".zstd"):
        import zstandard

        with open(path, "rb") as raw:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8")
    else:
        with open(path) as fh:
            yield from fh


def parse(log_dir: str) -> dict:
    stage_query: dict[int, str] = {}
    per_query: dict[str, dict] = {}
    for path in sorted(glob.glob(f"{log_dir}/**/*", recursive=True)):
        name = os.path.basename(path)
        if os.path.isdir(path) or "appstatus" in name or name.endswith(".crc"):
            continue
        for line in _lines(path):
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                desc = (ev.get("Properties") or {}).get("spark.job.description", "?")
                for sid in ev.get("Stage IDs", []):
                    stage_query[sid] = desc
            elif kind == "SparkListenerTaskEnd":
                m = ev.get("Task Metrics") or {}
                q = stage_query.get(ev.get("Stage ID"), "?")
                acc = per_query.setdefault(q, {"shuffle_write_bytes": 0, "task_ms": 0, "tasks": 0})
                acc["shuffle_write_bytes"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                acc["task_ms"] += m.get("Executor Run Time", 0)
                acc["tasks"] += 1
    return per_query


def run(sf_dir: str, log_dir: str) -> None:
    from pyspark.sql import SparkSession

    from tillroll.registry import QUERIES
    from tillroll.session import SCALE_CONF, ensure_checkpoint_dir
    from tillroll.sources import canonical as canon

    b = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "16")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", log_dir)
    )
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    sc.setJobDescription("_materialize_facts")
    canon.fact_transactions(spark, sf_dir)
    canon.calendar(spark, sf_dir)
    for name, q in QUERIES.items():
        sc.setJobDescription(name)
        q(spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.stop()


def main() -> None:
    if len(sys.argv) > 2 and sys.argv[1] == "--parse":
        print(json.dumps({"event_log": sys.argv[2], "queries": parse(sys.argv[2])}))
        return
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = sys.argv[2] if len(sys.argv) > 2 else tempfile.mkdtemp(prefix="tillroll-events-")
    run(sf_dir, log_dir)
    print(json.dumps({"sf_dir": sf_dir, "event_log": log_dir, "queries": parse(log_dir)}))


if __name__ == "__main__":
    main()
