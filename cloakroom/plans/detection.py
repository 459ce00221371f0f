"""Registered detection / anonymization queries over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakroom.functions import sqltext as Q
from cloakroom.functions.joins import small
from cloakroom.functions.text import explode_rows
from cloakroom.operators.anonymize import anonymize, detect_entities
from cloakroom.operators.detect import (
    DEFAULT_PATTERNS,
    Email,
    Entropy,
    Profile,
    floor_profile,
    guard_profile,
)
from cloakroom.operators.guard import egress_guard, leak_audit, vault_leaks
from cloakroom.operators.rehydrate import rehydrate
from cloakroom.operators.vault import session_resolver
from cloakroom.session import checkpoint_dir, materialize, stored
from cloakroom.sources.store import write_audit
from cloakroom.sources.tables import document_texts, page_texts, spread, table

PATTERN = {label: p for p, label in DEFAULT_PATTERNS[:2] + DEFAULT_PATTERNS[3:]}
AMEX = DEFAULT_PATTERNS[2][0]


def _all_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and raw pages, told apart by ``src``."""
    return document_texts(spark, sf).withColumn("src", F.lit("doc")).unionByName(page_texts(spark, sf).withColumn("src", F.lit("page")))


def _spans_query(texts: DataFrame, pattern: str, keys: list[str]) -> DataFrame:
    m = explode_rows(texts, F.expr(Q.regex_spans("`text`", pattern)), keys, "_p", "m")
    return m.select(
        *[k for k in keys if k != "ord"],
        F.col("ord").alias("id"),
        F.col("m.s").cast("bigint").alias("start_pos"),
        F.col("m.v").alias("value"),
    )


def detect_email(spark: SparkSession, sf: str) -> DataFrame:
    """E-mail spans in documents and raw pages."""
    texts = _all_texts(spark, sf)
    e = explode_rows(texts, Email().candidates(F.col("text"), 0)[0], ["src", "ord"], "_p", "c")
    return e.select(
        "src",
        F.col("ord").alias("id"),
        F.col("c.s").cast("bigint").alias("start_pos"),
        F.col("c.e").cast("bigint").alias("end_pos"),
        F.col("c.v").alias("email"),
    )


def _pattern_query(label: str):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        return _spans_query(_all_texts(spark, sf), "(?U)" + PATTERN[label], ["src", "ord"])

    q.__name__ = f"detect_{label}"
    return q


def derived_id_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts built from customer keys carrying SSN, IBAN and Amex shapes."""
    c = spread(table(spark, sf, "customer"))
    k = F.col("c_custkey")
    text = F.concat(
        F.lit("ssn "),
        F.lpad((k % 1000).cast("string"), 3, "0"),
        F.lit("-"),
        F.lpad((k % 100).cast("string"), 2, "0"),
        F.lit("-"),
        F.lpad((k % 10000).cast("string"), 4, "0"),
        F.lit(" iban GB"),
        F.lpad((k % 100).cast("string"), 2, "0"),
        F.lit("WEST"),
        F.lpad(k.cast("string"), 14, "0"),
        F.lit(" amex 3"),
        F.when(k % 2 == 0, F.lit("4")).otherwise(F.lit("7")),
        F.lpad((k % 100).cast("string"), 2, "0"),
        F.lit(" "),
        F.lpad(k.cast("string"), 6, "0"),
        F.lit(" "),
        F.lpad((k % 100000).cast("string"), 5, "0"),
        F.lit(" by "),
        F.col("c_name"),
    )
    return c.select(F.lit("cust").alias("session"), k.alias("ord"), F.lit(0).alias("field_pos"), text.alias("text"))


def detect_ids(spark: SparkSession, sf: str) -> DataFrame:
    """SSN / IBAN / Amex patterns over key-derived customer texts."""
    t = derived_id_texts(spark, sf)
    parts = []
    for label, p in (("ssn", PATTERN["ssn"]), ("iban", PATTERN["iban"]), ("amex", AMEX)):
        parts.append(_spans_query(t, "(?U)" + p, ["ord"]).withColumn("kind", F.lit(label)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("id", "c_custkey")


def detect_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """High-entropy tokens (secrets) with their entropy."""
    e = explode_rows(_all_texts(spark, sf), Entropy().candidates(F.col("text"), 0)[0], ["src", "ord"], "_p", "c")
    return e.select(
        "src",
        F.col("ord").alias("id"),
        F.col("c.s").cast("bigint").alias("start_pos"),
        F.col("c.v").alias("token"),
    )


def _floor_entities(spark: SparkSession, sf: str) -> DataFrame:
    return detect_entities(document_texts(spark, sf), floor_profile())


def detect_floor(spark: SparkSession, sf: str) -> DataFrame:
    """Reconciled floor entities (e-mail, structured, entropy) of documents."""
    e = _floor_entities(spark, sf)
    return e.select(
        F.col("ord").alias("doc_id"),
        F.col("s").cast("bigint").alias("start_pos"),
        F.col("e").cast("bigint").alias("end_pos"),
        "tag",
        "detector",
        F.col("v").alias("original"),
    )


def detect_floor_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Reconciled floor entities of raw pages."""
    e = detect_entities(page_texts(spark, sf), floor_profile())
    return e.select(F.col("ord").alias("page_id"), F.col("s").cast("bigint").alias("start_pos"), F.col("e").cast("bigint").alias("end_pos"), "tag", "detector", F.col("v").alias("original"))


def _anonymized_documents(spark: SparkSession, sf: str):
    return anonymize(document_texts(spark, sf), floor_profile())


def intern_session_vault(spark: SparkSession, sf: str) -> DataFrame:
    a = _anonymized_documents(spark, sf)
    return a.vault.select("session", "tag", "original", "n", "placeholder")


def anonymize_documents(spark: SparkSession, sf: str) -> DataFrame:
    a = _anonymized_documents(spark, sf)
    return a.sanitized.select(F.col("ord").alias("doc_id"), "text")


def audit_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """The audit trail, written by its sink and read again."""
    a = _anonymized_documents(spark, sf)
    path = f"{checkpoint_dir(spark).rstrip('/')}/audit-{uuid.uuid4().hex}"
    write_audit(a.audit, path)
    return spark.read.parquet(path).groupBy("tag", "detector").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def rehydrate_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    a = _anonymized_documents(spark, sf)
    back = rehydrate(a.sanitized, session_resolver(a.vault))
    return back.select(F.col("ord").alias("doc_id"), "text")


def egress_guard_blocked(spark: SparkSession, sf: str) -> DataFrame:
    """Mask e-mails only, then guard: sessions still holding structured ids are blocked."""
    a = anonymize(document_texts(spark, sf), Profile([Email()]))
    g = egress_guard(a.sanitized, guard_profile())
    return g.leaks.groupBy("session").agg(F.count(F.lit(1)).cast("bigint").alias("n_leaks"))


def leak_audit_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Leaks planted by sending every eleventh document as it was."""
    a = _anonymized_documents(spark, sf)
    raw = document_texts(spark, sf).select("session", "ord", "field_pos", F.col("text").alias("raw"))
    sent = a.sanitized.join(raw, ["session", "ord", "field_pos"]).withColumn("text", F.when(F.col("ord") % 11 == 0, F.col("raw")).otherwise(F.col("text")))
    return leak_audit(sent, a.entities).select(F.col("ord").alias("doc_id"), "tag")


def _keyless_documents(spark: SparkSession, sf: str) -> DataFrame:
    """documents with null sessions, null places, and pairs of documents at one place."""
    d = spread(table(spark, sf, "documents"))
    session = F.when(F.col("doc_id") % 3 != 0, F.col("source"))
    place = F.when(F.col("doc_id") % 5 != 0, F.floor(F.col("doc_id") / 40)).cast("long")
    return d.select("doc_id", session.alias("session"), place.alias("ord"), F.lit(0).alias("field_pos"), "text")


def anonymize_null_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without sessions or places and with repeated keys: masked, restored, and guarded.

    For the guard, what has no session and what is of src1 is sent as it was.
    """
    texts = _keyless_documents(spark, sf)
    a = anonymize(texts, floor_profile())
    masked = materialize(a.sanitized)
    back = rehydrate(masked, session_resolver(a.vault)).select("doc_id", F.col("text").alias("restored"))
    raw = F.col("session").isNull() | (F.col("session") == "src1")
    sent = masked.join(texts.select("doc_id", F.col("text").alias("raw")), "doc_id").withColumn("text", F.when(raw, F.col("raw")).otherwise(F.col("text")))
    g = egress_guard(sent, guard_profile())
    verdict = g.blocked.select("doc_id", F.lit("blocked").alias("verdict")).unionByName(g.released.select("doc_id", F.lit("released").alias("verdict")))
    return masked.select("doc_id", F.col("text").alias("masked")).join(back, "doc_id").join(verdict, "doc_id")


def vault_leaks_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Originals of a session, and customers' names of a durable layer, found in any text of it.

    Every 7th sanitized document of a source has one of the source's e-mail addresses glued between
    letters, where no detector sees it; every 13th document has a customer's name.
    """
    a = _anonymized_documents(spark, sf)
    masked = stored(a.sanitized)
    mails = a.vault.where("tag = 'EMAIL' AND n <= 3").select(F.col("session").alias("source"), F.col("n").alias("mail_nth"), F.col("original").alias("mail"))
    nth = F.when(F.col("ord") % 7 == 0, F.col("ord") % 3 + 1)
    c = table(spark, sf, "customer")
    names = c.select(F.col("c_custkey").alias("cust"), F.col("c_name").alias("name"))
    planted = masked.withColumn("nth", nth).withColumn("cust", F.when(F.col("ord") % 13 == 0, F.col("ord")))
    planted = planted.join(small(mails), (F.col("session") == F.col("source")) & F.col("nth").eqNullSafe(F.col("mail_nth")), "left").drop("source", "mail_nth")
    # only documents that get a name are shuffled for it
    named, others = planted.where(F.col("cust").isNotNull()), planted.where(F.col("cust").isNull())
    planted = named.join(names, "cust", "left").unionByName(others.withColumn("name", F.lit(None).cast("string")))
    glued = F.concat("text", F.coalesce(F.concat(F.lit(" zq"), "mail", F.lit("zq")), F.lit("")), F.coalesce(F.concat(F.lit(" zq"), "name", F.lit("zq")), F.lit("")))
    durable = c.select(F.lit("PERSON").alias("tag"), F.format_string("__PERSON_%d__", "c_custkey").alias("placeholder"), F.col("c_name").alias("original"))
    found = vault_leaks(planted.select("session", "ord", "field_pos", glued.alias("text")), a.vault, durable)
    return found.select(F.col("ord").alias("doc_id"), "tag", "placeholder")


def vocabulary_detectors(texts: DataFrame, vocab: DataFrame) -> tuple[DataFrame, list]:
    """Gazetteer of a vocabulary table (term, label, ins) of any size: terms attached to the texts, and the detector."""
    from cloakroom.operators.gazetteer_join import JoinedGazetteer, attach_terms

    return attach_terms(texts, vocab), [JoinedGazetteer()]


def benchmark_words(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct lower-cased word of benchmark as a private term."""
    b = table(spark, sf, "benchmark")
    words = b.select(F.explode(F.split(F.col("text"), r"[^\p{IsAlphabetic}\p{N}]+", -1)).alias("w"))
    terms = words.where(F.length("w") > 0).select(F.lower("w").alias("term")).distinct()
    return terms.select("term", F.lit("private").alias("label"), F.pmod(F.xxhash64("term"), F.lit(100_000_000)).cast("int").alias("ins"))


def detect_gazetteer(spark: SparkSession, sf: str) -> DataFrame:
    """Hits per (document, term) of all words of benchmark."""
    t, dets = vocabulary_detectors(document_texts(spark, sf), benchmark_words(spark, sf))
    c = explode_rows(t, Profile(dets).candidates(F.col("text")), ["ord"], "_p", "c")
    return c.groupBy(F.col("ord").alias("doc_id"), F.lower(F.col("c.v")).alias("term")).agg(
        F.count(F.lit(1)).cast("bigint").alias("hits")
    )


def benchmark_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct lower-cased word of benchmark and every pair of different words one space apart."""
    b = table(spark, sf, "benchmark")
    runs = F.regexp_extract_all(F.col("text"), F.lit(r"[\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+"), 0)
    r = b.select(F.posexplode(runs).alias("i", "w"), runs.alias("r"))
    word, gap, after = F.col("w"), F.try_element_at("r", F.col("i") + 2), F.try_element_at("r", F.col("i") + 3)
    words = r.where(word.rlike(r"^[\p{IsAlphabetic}\p{N}]"))
    pairs = words.where((gap == " ") & (F.lower(word) != F.lower(after))).select(F.lower(F.concat(word, F.lit(" "), after)).alias("term"))
    v = words.select(F.lower(word).alias("term")).unionByName(pairs).distinct()
    return v.select("term", F.lit("private").alias("label"), F.pmod(F.xxhash64("term"), F.lit(100_000_000)).cast("int").alias("ins"))


def detect_gazetteer_joined(spark: SparkSession, sf: str) -> DataFrame:
    """Hits per (document, term) of all words of benchmark and all its pairs of words."""
    t, dets = vocabulary_detectors(document_texts(spark, sf), benchmark_phrases(spark, sf))
    c = explode_rows(t, Profile(dets).candidates(F.col("text")), ["ord"], "_p", "c")
    return c.groupBy(F.col("ord").alias("doc_id"), F.lower(F.col("c.v")).alias("term")).agg(F.count(F.lit(1)).cast("bigint").alias("hits"))


def detect_customer_names(spark: SparkSession, sf: str) -> DataFrame:
    """All customer names as a vocabulary of two labels, found in the texts made of customers."""
    c = table(spark, sf, "customer")
    label = F.when(F.col("c_custkey") % 2 == 0, F.lit("person")).otherwise(F.lit("org"))
    vocab = c.select(F.col("c_name").alias("term"), label.alias("label"), F.col("c_custkey").cast("int").alias("ins"))
    t, dets = vocabulary_detectors(derived_id_texts(spark, sf), vocab)
    found = explode_rows(t, Profile(dets).detect(F.col("text")), ["ord"], "_p", "c")
    return found.select(F.col("ord").alias("c_custkey"), F.col("c.tag").alias("tag"), F.col("c.v").alias("original"), F.col("c.s").cast("bigint").alias("start_pos"))
