"""The interval join against the range join it stands for."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tillroll.plans.intervals import interval_join

DAY0 = dt.date(1998, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(5)
    keys = ["hot"] * 20 + ["a", "b", "c", None]
    points = [(i, rng.choice(keys), day(rng.randint(0, 4000)) if i % 50 else None) for i in range(2000)]
    spans = []
    for i in range(400):
        start = rng.randint(-500, 4000)
        length = rng.choice([0, 1, 1, 2, 4, 5, 16, 17, 30, 300, 3000, -3])
        spans.append((i, rng.choice(keys), day(start) if i % 40 else None, dt.date(9999, 12, 31) if i % 11 == 0 else day(start + length)))
    return (
        spark.createDataFrame(points, "id int, k string, d date").repartition(3),
        spark.createDataFrame(spans, "span int, k string, s date, e date").repartition(3),
    )


def rows(df):
    return sorted(str(r.asDict()) for r in df.collect())


def test_equals_the_range_join(frames):
    points, spans = frames
    want = points.alias("p").join(spans.alias("s"), (F.col("p.k") == F.col("s.k")) & (F.col("d") >= F.col("s.s")) & (F.col("d") < F.col("s.e")))
    want = want.select("id", F.col("p.k").alias("k"), "d", "span", F.col("s.s").alias("s"), "e")
    got = interval_join(points, spans, ["k"], "d", "s", "e")
    assert rows(got) == rows(want) and got.count() > 5000


def test_left_keeps_points_without_a_match_once(frames):
    points, spans = frames
    few = spans.where("span % 10 = 3")
    cond = (F.col("p.k") == F.col("s.k")) & (F.col("d") >= F.col("s.s")) & (F.col("d") < F.col("s.e"))
    want = points.alias("p").join(few.alias("s"), cond, "left").select("id", F.col("p.k").alias("k"), "d", "span", F.col("s.s").alias("s"), "e")
    got = interval_join(points, few, ["k"], "d", "s", "e", "left", ["id"])
    assert rows(got) == rows(want)


def test_rows_sent_do_not_grow_with_length(spark):
    """An interval is sent at most twice, whatever its length."""
    from tillroll.plans.intervals import CLASSES, _binned

    spans = [(i, day(i), day(i + n)) for i, n in enumerate([1, 3, 4, 5, 63, 64, 65, 1000, 100_000, 2_000_000])]
    df = _binned(spark.createDataFrame(spans, "span int, s date, e date"), F.col("s"), F.col("e"))
    assert max(r["count"] for r in df.groupBy("span").count().collect()) <= 2
    assert df.agg(F.countDistinct("_size")).first()[0] <= CLASSES + 1


def test_no_rows_and_bad_arguments(frames):
    points, spans = frames
    assert interval_join(points.where("false"), spans, ["k"], "d", "s", "e").count() == 0
    none = interval_join(points, spans.where("false"), ["k"], "d", "s", "e", "left", ["id"])
    assert none.count() == points.count() and none.where("span is not null").count() == 0
    with pytest.raises(ValueError):
        interval_join(points, spans, ["k"], "d", "s", "e", "left")
    with pytest.raises(ValueError):
        interval_join(points, spans.withColumn("id", F.lit(1)), ["k"], "d", "s", "e")
