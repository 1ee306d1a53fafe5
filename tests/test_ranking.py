from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillroll.plans.ranking import row_number_by


def test_row_number_by_matches_window_with_a_hot_key(spark):
    # Key 0 holds half of all rows; the rest are spread over 50 keys.
    rows = [(0 if i % 2 == 0 else i % 50, i // 7, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k bigint, d bigint, id bigint")
    got = row_number_by(df, ["k"], ["d", "id"], slices=6)
    want = df.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy("d", "id")))
    assert got.count() == 3000
    assert got.select("id", "rn").exceptAll(want.select("id", "rn")).count() == 0


def test_row_number_by_handles_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k bigint, id bigint")
    got = {r["id"]: r["rn"] for r in row_number_by(df, ["k"], ["id"], slices=3).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_row_number_by_reads_one_materialized_slicing(spark):
    """Both consumers of the slices read one checkpointed copy: the plan has a
    single range exchange, inside the checkpoint job, and none afterwards."""
    df = spark.createDataFrame([(i % 5, i) for i in range(500)], "k bigint, id bigint")
    out = row_number_by(df, ["k"], ["id"], slices=4)
    out.collect()
    assert "rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_row_number_by_without_exchange_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        rows = [(0 if i % 3 else i % 7, i) for i in range(600)]
        df = spark.createDataFrame(rows, "k bigint, id bigint")
        got = row_number_by(df, ["k"], ["id"], slices=5)
        want = df.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy("id")))
        assert got.select("id", "rn").exceptAll(want.select("id", "rn")).count() == 0
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")
