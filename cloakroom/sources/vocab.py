"""Private vocabulary source: the loader job.

Comma-separated terms plus term files (one per line), trimmed, blank lines and ``#``
comments dropped, in order. The result stays distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vocab_terms(spark: SparkSession, csv: str = "", files: list[str] | None = None, kind: str = "private") -> DataFrame:
    """(term, kind, ins): csv terms first, then file lines in file order."""
    csv_df = spark.createDataFrame([(csv or "",)], "line string").select(
        F.posexplode(F.split("line", ",", -1)).alias("pos", "term")
    ).select(F.lit(0).alias("src"), F.lit("").alias("f"), F.lit(0).cast("bigint").alias("b"), F.col("pos").cast("bigint").alias("pos"), "term")
    parts = [csv_df]
    for i, path in enumerate(files or [], start=1):
        # a file may be read in many splits: lines keep the order of split start and place in the split
        lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"), F.col("value").alias("term"))
        parts.append(lines.select(F.lit(i).alias("src"), "f", "b", F.col("m").alias("pos"), "term"))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    from cloakroom.operators.vault import number_by_first

    t = F.trim(F.col("term"))
    kept = df.withColumn("term", t).where((F.length("term") > 0) & ~F.col("term").startswith("#"))
    keyed = kept.select("term", F.lit(0).alias("_g"), F.struct("src", "f", "b", "pos").alias("_o"))
    numbered = number_by_first(keyed, ["_g"], "_o", out="ins")
    return numbered.select("term", F.lit(kind).alias("kind"), F.col("ins").cast("int").alias("ins"))

