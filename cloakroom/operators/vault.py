"""Vault: dictionary-encode (session, tag, original) -> ``__TAG_n__``.

``n`` numbers the distinct originals of one (session, tag) by first
occurrence, where occurrence order is (ord, field_pos, start). Secrets get a
placeholder but are never resolvable. Custom (vocabulary) kinds can live in a
durable layer instead, numbered per tag across runs.

Numbering never funnels a whole (session, tag) group through one task: the
distinct originals are range-partitioned on (keys, first occurrence), numbered
inside each range partition, and shifted by the counts of the same key in the
earlier range partitions. The offsets table has at most
(#keys + #partitions) rows, and each of its window groups at most
#partitions rows, so a session holding a third of all rows is split across as
many tasks as its volume needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakroom.functions.crypto import lookup_key, seal, unseal
from cloakroom.functions.joins import null_safe_join
from cloakroom.session import materialize

# Placeholder layout (fixed): two underscores, tag, underscore, number, two underscores.
PLACEHOLDER_FORMAT = "__%s_%d__"

ORIGIN_KEYS = ["session", "ord", "field_pos", "s"]


def placeholder(tag, n):
    return F.format_string(PLACEHOLDER_FORMAT, tag, n)


def number_by_first(df: DataFrame, keys: list[str], order: str | list[str], parts: int | None = None, out: str = "n") -> DataFrame:
    """Add ``out`` = 1..k to the rows of every ``keys`` group (null keys make groups, too), by ascending ``order``.

    ``order`` must be distinct inside a group. Two-phase rank: range
    partitions, local row_number, then offsets from the earlier partitions.
    """
    spark = df.sparkSession
    order = [order] if isinstance(order, str) else order
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Materialized once: the counts below and the local numbering must see the
    # very same range partitions, and two planned copies of the range exchange
    # (pruned differently) can sample different bounds.
    ranged = materialize(
        df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("_pid", F.spark_partition_id())
    )
    local = ranged.withColumn(
        "_local", F.row_number().over(Window.partitionBy("_pid", *keys).orderBy(*order))
    )
    counts = ranged.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", *keys, F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    return (
        null_safe_join(local, offsets, ["_pid", *keys])
        .withColumn(out, (F.col("_off") + F.col("_local")).cast("bigint"))
        .drop("_pid", "_local", "_off")
    )


def protected(entities: DataFrame, key: str | None) -> DataFrame:
    """Entity rows with ``lookup`` and ``sealed`` in place of the original ``v``.

    Everything behind this (checkpoints, shuffles, vault files) holds the keyed lookup
    and the sealed original alone; without a key both are the plain original.
    """
    return entities.withColumn("lookup", lookup_key(F.col("tag"), F.col("v"), key)).withColumn("sealed", seal(F.col("v"), key)).drop("v")


def distinct_originals(entities: DataFrame, session_scoped: bool = True) -> DataFrame:
    """One row per (session, tag, original) with its first occurrence (null places come first;
    originals that share a place, in rows of equal keys, are told apart by their lookup).

    A hash aggregate with map-side partial aggregation, so a repeated original
    (even one third of all rows) collapses before the shuffle.
    """
    first = F.struct(*[F.col(c) for c in (ORIGIN_KEYS if not session_scoped else ORIGIN_KEYS[1:])])
    keys = ["session", "tag", "lookup"] if session_scoped else ["tag", "lookup"]
    return entities.groupBy(*keys).agg(
        F.min(first).alias("first"),
        F.first("secret").alias("secret"),
        F.first("kind").alias("kind"),
        F.first("sealed").alias("sealed"),
    )


SESSION_VAULT = "session string, tag string, lookup string, sealed binary, n bigint, placeholder string, is_secret boolean"
DURABLE_VAULT = "tag string, lookup string, sealed binary, n bigint, placeholder string"


def intern_session(entities: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New rows of the ephemeral session vault (``SESSION_VAULT``) for protected entities.

    With ``existing`` rows only unseen originals are numbered, after the persisted
    maximum of their (session, tag).
    """
    v = distinct_originals(entities, session_scoped=True)
    if existing is not None:
        v = null_safe_join(v, existing.select("session", "tag", "lookup"), ["session", "tag", "lookup"], "left_anti")
    numbered = number_by_first(v, ["session", "tag"], ["first", "lookup"], out="_k")
    start = F.lit(0)
    if existing is not None:
        numbered = null_safe_join(numbered, existing.groupBy("session", "tag").agg(F.max("n").alias("_max")), ["session", "tag"], "left")
        start = F.coalesce(F.col("_max"), F.lit(0))
    numbered = numbered.withColumn("n", (start + F.col("_k")).cast("bigint"))
    return numbered.select("session", "tag", "lookup", "sealed", "n", placeholder(F.col("tag"), F.col("n")).alias("placeholder"), F.col("secret").alias("is_secret"))


def empty_durable(spark) -> DataFrame:
    return spark.createDataFrame([], DURABLE_VAULT)


def intern_durable(entities: DataFrame, existing: DataFrame) -> DataFrame:
    """New rows of the durable layer (``DURABLE_VAULT``) for protected entities of custom kinds.

    Existing (tag, lookup) rows keep their placeholder; unseen originals are numbered
    after the persisted maximum of their tag, by first occurrence (session, ord,
    field_pos, start). Only the new rows are returned, to be appended.
    """
    v = distinct_originals(entities.where("custom"), session_scoped=False)
    unseen = v.join(existing.select("tag", "lookup"), ["tag", "lookup"], "left_anti")
    numbered = number_by_first(unseen, ["tag"], ["first", "lookup"], out="_k")
    max_n = existing.groupBy("tag").agg(F.max("n").alias("_max"))
    joined = numbered.join(max_n, "tag", "left").withColumn("n", (F.coalesce(F.col("_max"), F.lit(0)) + F.col("_k")).cast("bigint"))
    return joined.select("tag", "lookup", "sealed", "n", placeholder(F.col("tag"), F.col("n")).alias("placeholder"))


def durable_resolver(durable: DataFrame, key: str | None = None) -> DataFrame:
    """placeholder -> original for a durable vault (decrypting with ``key``)."""
    return durable.select("placeholder", unseal(F.col("sealed"), key).alias("original"))


def session_resolver(vault: DataFrame, key: str | None = None) -> DataFrame:
    """placeholder -> original per session; secrets are absent by design."""
    original = F.col("original") if "original" in vault.columns else unseal(F.col("sealed"), key)
    return vault.where(~F.col("is_secret")).select("session", "placeholder", original.alias("original"))


def degraded_placeholder(tag, lookup):
    """Deterministic, unpersisted placeholder ``__TAG_h<hex>__`` for a failed intern.

    It is never written to a vault, so it can never be resolved: failing
    toward privacy when the durable store cannot be written. It is made of the
    lookup, so with a key the original can't be guessed from it.
    """
    digest = F.substring(F.sha2(F.concat(F.encode(tag, "UTF-8"), F.unhex(F.lit("1f")), F.encode(lookup, "UTF-8")), 256), 1, 16)
    return F.concat(F.lit("__"), tag, F.lit("_h"), digest, F.lit("__"))
