"""Corpus cleaning in five stages, each on all that the one before has kept.

Toxic documents go, one document of each near-duplicate group stays, repeated passages
are cut out, personal values are replaced, and the rest is packed into sequences. Every
stage is ``(spark, docs, sf_dir) -> DataFrame``; all but the last return the columns of
``documents``. ``run`` writes each stage as Parquet in the shared checkpoint folder and
reads it again for the next.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakroom.llm import ngram_join, packing, pii_pseudonyms, substring_dedup, toxicity
from cloakroom.llm.common import pack_rest, unpack_rest
from cloakroom.session import checkpoint_dir, materialize, ship_package
from cloakroom.sources.tables import table

#: Score from which a document is rejected as toxic.
TOXIC_FROM = 0.3


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the lexicon, learned from ``labels`` and these documents, scores as toxic.

    Null and empty texts score as the lexicon's base rate and stay, if it is below the bound;
    equal texts share their fate, so repeated rows all stay or go; texts of any length are
    read whole; an empty table stays one. Columns are untouched.
    """
    ship_package(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(F.col("text"), model) < TOXIC_FROM)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of linked documents.

    It is the one of least id (null ids last), then of least hash of id and text, then,
    among rows that agree in both, of least hash of all columns but maps. Null and empty
    texts are no duplicates and stay.
    """
    ship_package(spark)
    found = ngram_join.similar_documents(docs, with_group=True)
    rows = materialize(found.groupBy("group_key", "doc_id", "row_key").agg(F.count(F.lit(1)).alias("n")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "n"))
    kept = materialize(rows.groupBy("group_key").agg(first.alias("m")).select("m.row_key", "m.n"))
    repeated = kept.where("n > 1").select("row_key")
    gone = rows.select("row_key").join(kept, "row_key", "left_anti").unionByName(repeated).distinct()
    # the row as one column, whose fields can't clash with those of the join
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    order = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]).alias("place")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).alias("key")
    keyed = docs.select(whole, order, key, F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("words"))
    once = keyed.join(gone, (F.col("key") == F.col("row_key")) & F.col("words"), "left_anti").select("row")
    if not repeated.isEmpty():
        equal = keyed.where("words").join(repeated, F.col("key") == F.col("row_key"), "left_semi")
        once = once.unionByName(equal.groupBy("key").agg(F.min_by("row", "place").alias("row")).select("row"))
    return once.select("row.*")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out the windows of 13 words that an earlier document has, too.

    Null texts stay null, empty ones empty; rows of equal id are no earlier documents to
    each other, a null id is later than any other; texts of any length are looked at whole;
    an empty table stays one. All other columns stay as they are.
    """
    ship_package(spark)
    packed, schema = pack_rest(docs, ["doc_id", "text"])
    # what is behind the first character are the other columns
    marked = packed.select("doc_id", "text", F.concat(F.when(F.col("text").isNull(), "-").otherwise("+"), "_rest").alias("_rest"))
    cut = substring_dedup.remove_repeated_windows(marked, with_text=True, carry="_rest")
    text = F.when(F.col("_rest").startswith("+"), F.col("text")).alias("text")
    out = cut.select("doc_id", text, F.substring("_rest", 2, 1 << 30).alias("_rest"))
    return _as(docs, unpack_rest(out, schema))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal values by keyed pseudonyms of their own format.

    Null texts stay null, empty ones empty; equal values have equal pseudonyms in all rows,
    repeated ones included; texts of any length are read whole; an empty table stays one.
    All columns but the text (and its length) are untouched.
    """
    return _as(docs, docs.withColumn("text", pii_pseudonyms.pseudonymize("text", pii_pseudonyms.session_key(spark))))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of what is left into sequences of 2048.

    Null and empty texts are the end id alone; rows of equal or null ids are packed like any
    other, repeated ones as often as they are there; longer texts are cut into pieces of 2048;
    an empty table gives no sequences. Other columns are not read.
    """
    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def _as(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` in the columns and types of ``docs``, the length of the text made anew."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")))
    return changed.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in docs.schema])


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: No stage but the third can be said in SQL (a learned score, MinHash pruning, keyed rounds, a linear program).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
