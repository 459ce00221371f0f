"""Readers for the parquet tables and their canonical text layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy text scans at least one partition per core.

    A table stored as a few large row groups scans as a few tasks; text
    detection is CPU-bound, so such inputs are spread round-robin. Inputs that
    already have enough splits (the normal case at scale) are left as they are.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as texts: a session per ``source``, ordered by ``doc_id``."""
    d = table(spark, sf_dir, "documents")
    return spread(d).select(
        F.col("source").alias("session"),
        F.col("doc_id").alias("ord"),
        F.lit(0).alias("field_pos"),
        "text",
    )


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as texts: one session per page, the raw html is the text."""
    p = table(spark, sf_dir, "pages")
    return spread(p).select(
        F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("session"),
        F.col("page_id").alias("ord"),
        F.lit(0).alias("field_pos"),
        F.col("html").alias("text"),
    )


def conversation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as texts: a session per ``conv_id``, ordered by ``turn``."""
    c = table(spark, sf_dir, "conversations")
    return spread(c).select(
        F.col("conv_id").cast("string").alias("session"),
        F.col("turn").alias("ord"),
        F.lit(0).alias("field_pos"),
        "text",
    )
