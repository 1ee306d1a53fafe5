"""Corpus pipeline: language ID, n-gram Jaccard join, benchmark
decontamination, personal data, packing.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes as Parquet and reads again as the
next stage's ``docs``.  All but the last return the columns of ``documents``.

Defined cases are those of the operators; in addition a stage keeps the rows'
other columns, and ``n_chars`` (if there is one) follows a changed text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import decontamination, jaccard_join, langid, packing, pii
from tillroll.session import shared_dir
from tillroll.sources.tables import read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected; a missing label is filled in."""
    found = langid.identify(docs, langid.fit(docs, F.lit(True))).where(~F.col("rejected"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class."""
    classes = jaccard_join.saved(jaccard_join.jaccard_classes(docs), "classes").where("doc_id is not null")
    rest = jaccard_join.small(classes.where("doc_id != class_id").select("doc_id").distinct())
    kept = docs.join(rest, "doc_id", "left_anti")
    twice = classes.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.limit(1).count():  # repeated rows of an id
        once = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(twice, "doc_id", "left_anti").union(once)
    return kept.select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are contaminated by the benchmark."""
    found = decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    found = pii.redact(docs, pii.fit(docs))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; see tillroll.llm.packing."""
    return packing.op5_pack(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("decontaminate", decontaminate),
    ("redact", redact),
    ("pack", pack),
]

# No SQL: compression, min-hash, boosted trees and tokenizers are beyond it;
# tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
