"""Session helpers for tests, the benchmark and local runs.

On a cluster the session comes from the platform; library code never builds
one.  ``shared_dir`` resolves the shared folder named by
``spark.checkpoint.dir`` and only invents one when the setting is absent
(local tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter for the analyses at any scale: adaptive execution
# (runtime broadcast decisions from real sizes, partition coalescing, skew-join
# splitting) and a fixed session time zone so DATE casts are stable.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tillroll") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TILLROLL_DRIVER_MEMORY", "8g"))
    )
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # sessions without a local SparkContext (Spark Connect)
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint folder); only when neither is set and the master is local
    (tests) a scratch folder is created and given to the SparkContext; on a
    cluster a missing setting is an error, since executors do not share local
    folders.  The conf itself is never changed (Spark rejects changing it at
    runtime).
    """
    sc = _context(spark)
    current = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    if not current:
        if sc is None or not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="tillroll-ckpt-")
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (for written tables)."""
    sc = _context(spark)
    base = (sc.getCheckpointDir() if sc else None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
