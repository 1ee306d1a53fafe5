"""Row numbering that does not put one hot key into one task.

``Window.partitionBy(key)`` sends every row of a key to one task.  When a
single key can hold a large share of the data (one customer with a third of
all orders), that task becomes the whole job.  ``row_number_by`` numbers rows
in three bounded steps instead:

1. range-partition on (key, order columns): a hot key is cut into slices that
   land in different tasks, each slice sorted;
2. number rows inside each (slice, key) group - at most one slice of rows;
3. add the row counts of the earlier slices of the same key.  Only keys that
   cross a slice border have such an offset, at most two per border, so the
   offset table is bounded by the number of slices and is broadcast.

Steps 2 and 3 both read the numbered slices, and their slice ids must agree.
Two plan branches over one range repartition are not guaranteed to share its
shuffle (column pruning can make them differ, and then each samples its own
bounds), so the sliced, locally numbered rows are checkpointed once to the
shared checkpoint folder and both steps read that copy.  The checkpoint also
cuts lineage, so a lost executor never re-samples the bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillroll.session import ensure_checkpoint_dir


def _num_slices(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def row_number_by(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    out: str = "rn",
    slices: int | None = None,
) -> DataFrame:
    """Add ``out`` = ROW_NUMBER() OVER (PARTITION BY keys ORDER BY order).

    ``order`` must be a total order inside each key for a deterministic
    result (same requirement as the window function).  Other columns pass
    through; they are written once with the checkpoint, so keep them small.
    """
    n = slices or _num_slices(df)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(n, *[F.col(k) for k in keys], *order_cols).withColumn(
        "_slice", F.spark_partition_id()
    )
    local = ranged.withColumn(
        "_local_rn", F.row_number().over(W.partitionBy("_slice", *keys).orderBy(*order_cols))
    ).checkpoint(eager=True)
    per_slice = local.groupBy("_slice", *keys).agg(F.max("_local_rn").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    renamed = {k: f"_o{i}" for i, k in enumerate(keys)}
    offsets = (
        per_slice.withColumn("_offset", F.sum("_n").over(before))
        .filter(F.col("_offset") > 0)
        .select(F.col("_slice").alias("_o_slice"), *[F.col(k).alias(v) for k, v in renamed.items()], "_offset")
    )
    # NULL is a key value like any other (as in PARTITION BY): null-safe match.
    cond = [F.col("_slice") == F.col("_o_slice")] + [F.col(k).eqNullSafe(F.col(v)) for k, v in renamed.items()]
    return (
        local.join(F.broadcast(offsets), cond, "left")
        .withColumn(out, (F.col("_local_rn") + F.coalesce(F.col("_offset"), F.lit(0))).cast("bigint"))
        .drop("_slice", "_local_rn", "_offset", "_o_slice", *renamed.values())
    )
