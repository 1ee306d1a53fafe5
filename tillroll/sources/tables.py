"""Reading the raw parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One raw table; column pruning and filters reach the scan through Catalyst."""
    return spark.read.parquet(table_path(sf_dir, name))
