"""A fact table laid out by customer.

Many analyses group, number or join a customer's lines.  ``write_customer_facts``
stores the lines partitioned by order month and bucketed by customer inside, so
those steps read whole customers per task and need no shuffle; a date window
still reads its months only.

A customer with more than ``hot_rows`` lines would be one task however many
buckets there are.  Such customers are found by one grouped count (the few that
exceed the limit are at most rows / hot_rows) and their lines are stored apart,
by month alone.  Customers are disjoint between the two parts, so a per-customer
step runs on each: on the bucketed part without a shuffle, on the hot part with
the plan that splits a hot key.  ``per_customer`` does both and unites the rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillroll.plans.written import written
from tillroll.session import shared_dir

KEY = "customer_id"
BUCKET_ROWS = 750_000  # lines of a bucket over all months: a task sorts them in memory, in less than 1 GB
HOT_ROWS = 750_000  # lines of a customer that goes to the hot part
FILE_ROWS = 5_000_000


@dataclass
class CustomerFacts:
    """``regular``: bucketed by customer; ``hot``: the lines of customers with
    many, or None if there is no such customer."""

    regular: DataFrame
    hot: DataFrame | None

    def lines(self) -> DataFrame:
        """All lines."""
        return self.regular if self.hot is None else self.regular.unionByName(self.hot)

    def map(self, fn: Callable[[DataFrame], DataFrame]) -> CustomerFacts:
        """The facts with ``fn`` (a row-wise step) applied to both parts."""
        return CustomerFacts(fn(self.regular), None if self.hot is None else fn(self.hot))


def lines_of(tx: DataFrame | CustomerFacts) -> DataFrame:
    return tx.lines() if isinstance(tx, CustomerFacts) else tx


def per_customer(
    tx: DataFrame | CustomerFacts, fn: Callable[[DataFrame], DataFrame], split: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """``fn`` over the lines of all customers.  ``fn`` must treat customers
    apart (its rows of a customer come from that customer's lines).

    ``split`` is the same step by a plan that splits a hot customer; it is used
    for the hot part and for frames without a layout (``fn`` if not given).
    """
    split = split or fn
    if not isinstance(tx, CustomerFacts):
        return split(tx)
    found = fn(tx.regular)
    return found if tx.hot is None else found.unionByName(split(tx.hot))


def split_hot(lines: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None, int]:
    """(lines of the regular customers, lines of the hot ones or None, rows of
    the regular part).  NULL is a customer like any other.  ``lines`` should be
    a scan: it is read for the counts and again for the rows."""
    counts = written(lines.groupBy(KEY).count(), "lines-per-customer")
    is_hot = F.col("count") > hot_rows
    n_hot, rows = counts.agg(F.count_if(is_hot), F.coalesce(F.sum(F.when(~is_hot, F.col("count"))), F.lit(0))).first()
    if not n_hot:
        return lines, None, rows
    hot = written(counts.where(is_hot).select(F.col(KEY).alias("_hot")), "hot-customers")
    same = F.col(KEY).eqNullSafe(F.col("_hot"))
    return lines.join(hot, same, "left_anti"), lines.join(hot, same, "left_semi"), rows


def write_customer_facts(
    spark: SparkSession,
    lines: DataFrame,
    finish: Callable[[DataFrame], DataFrame] = lambda df: df,
    finish_hot: Callable[[DataFrame], DataFrame] | None = None,
    *,
    month: str = "order_month",
    hot_rows: int = HOT_ROWS,
    bucket_rows: int = BUCKET_ROWS,
    cluster: Sequence[str] = (),
    bloom: Sequence[str] = (),
    options: Mapping[str, str] | None = None,
) -> CustomerFacts:
    """Write ``lines`` in this layout and read it back.

    ``finish`` adds columns to the regular lines once they are distributed by
    customer, so windows over a customer's lines cost no further shuffle;
    ``finish_hot`` does the same for the hot lines by a plan that splits them.
    Buckets follow from the rows, and are not fewer than the cores.

    Files are sorted by ``cluster``, so a filter on those columns skips row
    groups by their statistics; ``bloom`` columns get Bloom filters in the
    files, for equality on columns that the sort scatters; they are as large as
    a file's values need (a fixed size would be 1 MB a file).  ``options`` go to
    the Parquet writer.
    """
    options = dict(options or {}) | {f"parquet.bloom.filter.enabled#{c}": "true" for c in bloom}
    if bloom:
        options = {"parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.candidates.number": "10"} | options
    regular, hot, rows = split_hot(lines, hot_rows)
    buckets = max(spark.sparkContext.defaultParallelism, math.ceil(rows / bucket_rows))
    name = f"customer_facts_{uuid.uuid4().hex[:8]}"
    ready = finish(regular.repartition(buckets, KEY))
    writer = ready.write.options(**options).partitionBy(month).bucketBy(buckets, KEY)
    if cluster:
        writer = writer.sortBy(*cluster)
    writer.option("path", shared_dir(spark, "customer-facts")).option("maxRecordsPerFile", FILE_ROWS).saveAsTable(name)
    table = spark.table(name).select(*ready.columns)
    if hot is None:
        return CustomerFacts(table, None)
    path = shared_dir(spark, "hot-customer-facts")
    apart = (finish_hot or finish)(hot)
    if cluster:
        apart = apart.sortWithinPartitions(month, *cluster)
    apart.write.options(**options).partitionBy(month).option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return CustomerFacts(table, spark.read.schema(apart.schema).parquet(path).select(*ready.columns))


def first_of(valid: Column, day: Column, keys: list[str]) -> Column:
    """Earliest ``day`` among the valid lines with the same ``keys`` (a window;
    free of a shuffle if the lines are distributed by one of the keys)."""
    return F.min(F.when(valid, day)).over(W.partitionBy(*keys))
