"""Streaming anonymization with an append-only session vault.

Each micro-batch runs the batch operators: detect, drop what the vault already has,
number the rest after the vault's maximum, append the new vault rows, splice. Nothing
is kept in operator state, so a session holding a third of all texts is split like in
batch. A micro-batch writes its vault rows, audit and texts under its own number and
reads only earlier numbers, so a repeated micro-batch writes the same again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloakroom.functions.joins import null_safe_join
from cloakroom.operators.anonymize import audit_rows, detect_entities, replace_spans
from cloakroom.operators.detect import Profile
from cloakroom.operators.vault import SESSION_VAULT, intern_session, protected
from cloakroom.session import materialize

PART = "batch bigint"


def _part(spark: SparkSession, base: str, name: str, schema: str) -> DataFrame:
    """All that the micro-batches have written under ``name`` (with their number)."""
    return spark.read.schema(f"{schema}, {PART}").parquet(f"{base}/{name}")


def _write(df: DataFrame, base: str, name: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch}")


def read_vault(spark: SparkSession, base: str) -> DataFrame:
    return _part(spark, base, "vault", SESSION_VAULT)


def anonymize_stream(texts: DataFrame, profile: Profile, base: str, key: str | None = None) -> StreamingQuery:
    """Start the query over streaming ``texts`` (session, ord, field_pos, text); availableNow.

    Below ``base``: ``vault``, ``audit`` and ``out`` (sanitized texts), and ``state``, the
    stream's own checkpoint. With ``key`` the vault holds keyed lookups and sealed originals.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ents = materialize(protected(detect_entities(batch, profile, key=key), key))
        earlier = None
        if number:
            earlier = _part(spark, base, "vault", SESSION_VAULT).where(F.col("batch") < number).drop("batch")
        new = materialize(intern_session(ents, earlier))
        _write(new, base, "vault", number)
        vault = new if earlier is None else earlier.unionByName(new)
        with_ph = materialize(null_safe_join(ents, vault.select("session", "tag", "lookup", "placeholder"), ["session", "tag", "lookup"]))
        _write(audit_rows(with_ph), base, "audit", number)
        _write(replace_spans(batch, with_ph, key), base, "out", number)

    return texts.writeStream.foreachBatch(one).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
