"""Parquet-backed stores: append-only tables, memory insert, sinks.

A table is a folder of Parquet files. Writers append the rows that are new (Spark's
commit makes a job's files appear at once or not at all); readers take all files.
Inserts and vault increments compute their new rows against what is there, so a
repeated job adds nothing. Changes of existing rows (recalls, deletions) are a rewrite
to another folder by the job that owns the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakroom.operators.vault import DURABLE_VAULT as VAULT_SCHEMA  # noqa: F401

MEMORY_SCHEMA = (
    "id string, content string, kind string, egress_policy string, created_ms bigint, "
    "recall_count bigint, accessed_ms bigint, promoted boolean"
)


def open_table(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """The rows of the table at ``base``, or an empty one (create-if-absent); older files get the missing columns."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return migrate(spark.read.option("mergeSchema", "true").parquet(base), schema)


def append(rows: DataFrame, base: str) -> None:
    """Add new rows to the table at ``base``."""
    rows.write.mode("append").parquet(base)


def migrate(df: DataFrame, schema: str) -> DataFrame:
    """Additive migration: add missing columns of ``schema`` (numbers 0, flags false)."""
    from pyspark.sql.types import _parse_datatype_string

    want = _parse_datatype_string(schema)
    cols = []
    for f in want.fields:
        default = F.lit(0) if f.dataType.typeName() in ("long", "integer") else F.lit(False) if f.dataType.typeName() == "boolean" else F.lit(None)
        # files older than a column give nulls for it once a newer file has it
        there = [F.col(f.name)] if f.name in df.columns else []
        cols.append(F.coalesce(*there, default).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def insert_memories(current: DataFrame, new: DataFrame) -> DataFrame:
    """The rows to append for inserting ``new`` (content, kind, egress_policy, created_ms).

    Content is trimmed and must be non-empty; kind defaults to ``fact``; the
    policy is normalised; ids are content hashes, so a retried insert is a
    no-op; counts start at 0 and ``accessed_ms`` at ``created_ms``.
    """
    from cloakroom.operators.memory import memory_id, normalize_policy

    content = F.trim(F.col("content"))
    kind = F.when(F.length(F.trim(F.coalesce(F.col("kind"), F.lit("")))) > 0, F.trim(F.col("kind"))).otherwise(F.lit("fact"))
    rows = new.where(F.length(content) > 0).select(
        memory_id(content, kind, F.col("created_ms").cast("string")).alias("id"),
        content.alias("content"),
        kind.alias("kind"),
        normalize_policy(F.coalesce(F.col("egress_policy"), F.lit(""))).alias("egress_policy"),
        F.col("created_ms").cast("bigint").alias("created_ms"),
        F.lit(0).cast("bigint").alias("recall_count"),
        F.col("created_ms").cast("bigint").alias("accessed_ms"),
        F.lit(False).alias("promoted"),
    )
    return rows.dropDuplicates(["id"]).join(current.select("id"), "id", "left_anti")


def memory_indexes(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings and embeddings derived from memories in the same job as the insert."""
    from cloakroom.operators.memory import hash_embed, postings

    post, _ = postings(memories)
    emb = hash_embed(memories, "id", "content", out="vector").withColumnRenamed("id", "memory_id")
    return post, emb


def write_audit(audit: DataFrame, path: str) -> None:
    """Audit trail sink: metadata only (never the original text)."""
    audit.select("session", "ord", "field_pos", "pos", "kind", "tag", "detector", "score").write.mode("append").parquet(path)


def export_markdown(lines: DataFrame, path: str) -> None:
    """Ordered text files: reading them by name gives the lines in order."""
    lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)
