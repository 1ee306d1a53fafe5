"""Join inputs as written tables.

Adaptive execution splits a skewed join partition when both join inputs are
plain shuffle stages.  An input that comes straight from an aggregate is
already partitioned by the key, and then a hot key's rows stay in one task.
Writing such an input (a row per key, so it is small beside the other side) to
the shared folder and reading it back makes both inputs plain scans: Spark
shuffles both and splits a hot key by the sizes it measures.  Nothing is
counted in advance, no key list is kept, and no row is salted.  The written
table also cuts lineage, so a lost executor does not recompute the aggregate.

Where the rows of a split join go on into a grouping by the same key, Spark
splits only with ``spark.sql.adaptive.forceOptimizeSkewedJoin`` (see
``session.SCALE_CONF``), at the price of one more shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tillroll.session import shared_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``df`` written as a table bucketed by ``key`` and read back: what goes by
    ``key`` and more needs no shuffle."""
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    df.write.bucketBy(buckets, key).option("path", shared_dir(df.sparkSession, name)).saveAsTable(table)
    return df.sparkSession.table(table).select(*df.columns)
