"""Joins against written tables: results and the split of a hot key."""

import re

import pytest
from pyspark.sql import functions as F

from tillroll.plans.written import written

SMALL = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def small(spark):
    old = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def lines(spark):
    """Key 7 holds a third of the rows, a hundred keys tie, some are null."""
    k = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 101 == 0, None).otherwise(F.col("id") % 100)
    return spark.range(60_000).select(k.alias("k"), F.col("id").alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("pad")).repartition(8, "v")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_same_rows_as_the_plain_join(small, how):
    big = lines(small)
    keys = big.groupBy("k").agg(F.max("v").alias("top")).filter("k < 60")
    got = big.join(written(keys, "keys"), "k", how).groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    want = big.join(keys, "k", how).groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_hot_key_is_split(small):
    big = lines(small)
    joined = big.join(written(big.groupBy("k").agg(F.max("v").alias("top")), "keys"), "k")
    assert joined.agg(F.sum(F.length("pad"))).first()[0]
    joined.write.format("noop").mode("overwrite").save()
    df = joined.select(F.max("pad"))
    df.collect()
    assert re.search("skew=true", df._jdf.queryExecution().executedPlan().toString())
