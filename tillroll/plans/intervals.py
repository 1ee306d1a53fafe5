"""Joining points in time with the intervals that hold them, without expanding
intervals to days.

An equi-join needs a key.  Each interval goes to bins of its own length class:
the smallest class whose bins are at least as long, so it touches two bins at
most.  Classes grow by ``BASE``, so days from year 1 to 9999 need 11 of them,
and a point is sent once for each class that the intervals of the whole table
have (one bounded, broadcast row), into the one bin that holds it.  A match is
met in exactly one bin, since a point lies in one bin of the interval's class,
and the exact test of the bounds is the join's residual.  Neither side's rows
grow with the length of intervals or of the time that is looked at.

A key whose rows are many is spread over its bins, and Spark splits what is
left by the sizes it measures, as both sides are plain shuffled inputs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = 4
CLASSES = 11  # BASE^CLASSES days are more than 9999 years


def _day(c: Column) -> Column:
    return F.unix_date(c.cast("date")).cast("bigint")


def _binned(intervals: DataFrame, start: Column, end: Column) -> DataFrame:
    """Intervals [start, end) that hold a day, a row for each of their bins."""
    first, last = _day(start), _day(end) - 1
    length = last - first + 1
    size = F.lit(BASE**CLASSES).cast("bigint")
    for k in reversed(range(CLASSES)):
        size = F.when(length <= BASE**k, F.lit(BASE**k).cast("bigint")).otherwise(size)
    sized = intervals.withColumn("_first", first).withColumn("_last", last).where("_first <= _last").withColumn("_size", size)
    bins = F.sequence(F.floor(F.col("_first") / F.col("_size")), F.floor(F.col("_last") / F.col("_size")))
    return sized.withColumn("_bin", F.explode(bins))


def interval_join(points: DataFrame, intervals: DataFrame, on: Sequence[str], at: str, start: str, end: str, how: str = "inner", row_id: Sequence[str] = ()) -> DataFrame:
    """``points`` with the columns of the ``intervals`` [start, end) of the same
    keys ``on`` that hold the day ``at``.

    NULL keys, days and bounds match nothing; an interval that ends before it
    starts holds no day.  ``how`` is ``inner`` or ``left``; a left join names
    the columns ``row_id`` that tell one point from another, and a point
    without a match comes back once with NULLs.
    """
    if how not in ("inner", "left") or (how == "left" and not row_id):
        raise ValueError("how is inner, or left with row_id")
    taken = [c for c in intervals.columns if c not in on and c in points.columns]
    if taken:
        raise ValueError(f"columns of both sides: {taken}")
    binned = _binned(intervals, F.col(start), F.col(end))
    sizes = binned.agg(F.collect_set("_size").alias("_sizes"))  # one row, CLASSES + 1 sizes at most
    day = _day(F.col(at))
    sent = points.where(day.isNotNull()).withColumn("_day", day).crossJoin(F.broadcast(sizes))
    sent = sent.withColumn("_size", F.explode("_sizes")).drop("_sizes").withColumn("_bin", F.floor(F.col("_day") / F.col("_size")))
    met = sent.join(binned, [*on, "_size", "_bin"]).where("_day between _first and _last")
    added = [c for c in intervals.columns if c not in on]
    inner = met.select(*points.columns, *added)
    if how == "inner":
        return inner
    matched = inner.select(*[F.col(c).alias(f"_id_{i}") for i, c in enumerate(row_id)]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_id_{i}")) for i, c in enumerate(row_id)]
    rest = points.join(matched, same, "left_anti")
    nulls = [F.lit(None).cast(intervals.schema[c].dataType).alias(c) for c in added]
    return inner.unionByName(rest.select(*points.columns, *nulls))
