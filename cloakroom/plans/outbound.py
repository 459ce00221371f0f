"""Request-level outbound job and reply restoration (batch form of the request path).

``prepare_outbound``: recall memories for each request (keyword + vector,
fused), select the injectable ones within the token budget and inject their
block as message ``ord = -1`` (so they take the lowest placeholder numbers),
count the recalls, build the detection floor from the vocabulary plus the
contents of local-only memories, anonymize every message, and guard the
result: sessions with a leak are blocked as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakroom.operators import memory as M
from cloakroom.operators.anonymize import anonymize
from cloakroom.operators.detect import Email, Entropy, Profile, RegexSet
from cloakroom.operators.guard import egress_guard
from cloakroom.operators.gazetteer_join import JoinedGazetteer, attach_terms
from cloakroom.operators.transcript import gather_text
from cloakroom.session import materialize


@dataclass
class Outbound:
    released: DataFrame
    blocked: DataFrame
    audit: DataFrame
    vault: DataFrame
    memories: DataFrame


def select_memories(messages: DataFrame, memories: DataFrame, embed=M.hash_embed) -> DataFrame:
    """The memories injected into each session's request: recalled by keyword and vector, fused, within the budget."""
    queries = gather_text(messages, "session", "ord", "text").select(F.col("session").alias("qid"), "text")
    kw = M.recall(queries, memories)
    sem = M.vector_top_k(embed(queries, "qid", "text"), embed(memories, "id", "content"))
    return M.select_injectable(M.fuse(kw, sem), memories)


def recalled(memories: DataFrame, selected: DataFrame, now_ms: int) -> DataFrame:
    """``memories`` with the recalls of ``selected`` counted."""
    return M.record_recalls(memories, selected.select("id", F.lit(now_ms).cast("bigint").alias("ts_ms"), F.xxhash64("qid", "id").alias("ev")))


def prepare_outbound(messages: DataFrame, memories: DataFrame, vocab: DataFrame, now_ms: int, embed=M.hash_embed) -> Outbound:
    """messages: session, ord, text. vocab: term, label, ins (applies to every session)."""
    selected = select_memories(messages, memories, embed)
    block = M.memory_block(selected).select(
        F.col("qid").alias("session"), F.lit(-1).cast("bigint").alias("ord"), F.col("block").alias("text")
    )
    texts = block.unionByName(messages.select("session", F.col("ord").cast("bigint"), "text")).withColumn("field_pos", F.lit(0))
    memories_after = recalled(memories, selected, now_ms)

    local_terms = memories.where(F.col("egress_policy") == "local_only").select(
        F.col("content").alias("term"), F.lit("private").alias("label"), F.lit(1_000_000).alias("ins")
    )
    terms = vocab.select("term", "label", "ins").unionByName(local_terms)
    # the injected block and the recall behind it are read by several jobs: once is enough
    texts = materialize(texts)
    floor = Profile([JoinedGazetteer(), Email(), RegexSet(), Entropy()])
    a = anonymize(attach_terms(texts, terms), floor)
    # the guard looks for the terms afresh: placeholders and splices are part of what it reads
    sent = materialize(a.sanitized.drop("_terms"))
    g = egress_guard(attach_terms(sent, terms), Profile([JoinedGazetteer(), Email(), RegexSet()]))
    keep = ["session", "ord", "field_pos", "text"]
    return Outbound(g.released.select(*keep), g.blocked.select(*keep), a.audit, a.vault, memories_after)


NOW_MS = 1_800_000_000_000


def _requests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every conversation as one request, and the memories made of benchmark."""
    from cloakroom.plans.memory_queries import memories as mem_table
    from cloakroom.sources.tables import table

    msgs = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("ord"), "text")
    return msgs, mem_table(spark, sf).drop("item_id")


def recalls_of_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """The memories after the conversations' requests have recalled from them."""
    msgs, mem = _requests(spark, sf)
    return recalled(mem, select_memories(msgs, mem), NOW_MS)


def prepare_outbound_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as requests; the vocabulary is every word of benchmark."""
    from cloakroom.plans.detection import benchmark_words

    msgs, mem = _requests(spark, sf)
    out = prepare_outbound(msgs, mem, benchmark_words(spark, sf).withColumn("ins", F.lit(0)), now_ms=NOW_MS)
    return out.released.select(F.col("session").cast("bigint").alias("conv_id"), F.col("ord").alias("turn"), "text")
