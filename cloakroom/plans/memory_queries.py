"""Registered memory / recall queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakroom.operators import memory as M
from cloakroom.operators.transcript import gather_text
from cloakroom.sources.tables import spread, table

BASE_MS = 1_700_000_000_000


def epoch_millis(ts):
    """Milliseconds since the epoch of a wall-clock (NTZ) timestamp, independent of the session zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts._jc.toString()})")


def memories(spark: SparkSession, sf: str) -> DataFrame:
    """benchmark items as stored memories (every 4th item is local-only)."""
    b = table(spark, sf, "benchmark")
    created = (F.lit(BASE_MS) + F.col("item_id") * 60000).cast("bigint")
    raw_policy = F.when(F.col("item_id") % 4 == 0, F.lit(" Local-Only")).otherwise(F.lit("anonymized"))
    return b.select(
        M.memory_id(F.col("item_id").cast("string"), F.col("text")).alias("id"),
        F.col("text").alias("content"),
        F.lit("fact").alias("kind"),
        M.normalize_policy(raw_policy).alias("egress_policy"),
        created.alias("created_ms"),
        F.lit(0).cast("bigint").alias("recall_count"),
        created.alias("accessed_ms"),
        F.lit(False).alias("promoted"),
        F.col("item_id"),
    )


def recall_queries(spark: SparkSession, sf: str) -> DataFrame:
    """One recall query per conversation: all its turns joined by newlines."""
    c = spread(table(spark, sf, "conversations"))
    return gather_text(c, "conv_id", "turn", "text").select(F.col("conv_id").alias("qid"), F.col("text"))


def chat_gather_text(spark: SparkSession, sf: str) -> DataFrame:
    return recall_queries(spark, sf).select(F.col("qid").alias("conv_id"), "text")


def memory_recall_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword recall as a request does it: the first 32 distinct words of each conversation."""
    return M.recall(recall_queries(spark, sf), memories(spark, sf), cap=32).select(
        F.col("qid").alias("conv_id"), "id", F.col("rk").cast("bigint").alias("rk")
    )


def memory_recall_all_words(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword recall by every word of each conversation."""
    return M.recall(recall_queries(spark, sf), memories(spark, sf)).select(
        F.col("qid").alias("conv_id"), "id", F.col("rk").cast("bigint").alias("rk")
    )


def memory_semantic_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Hash-embedding search with one query per order over all parts."""
    o, p = table(spark, sf, "orders"), table(spark, sf, "part")
    mark = lambda c: F.concat(F.lit(" k"), (F.col(c) % 97).cast("string"))
    q = o.select(F.col("o_orderkey").alias("qid"), F.concat("o_orderpriority", mark("o_orderkey")).alias("text"))
    i = p.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), "p_type", F.lit(" low medium high urgent"), mark("p_partkey")).alias("text"))
    s = M.vector_top_k(M.hash_embed(q, "qid", "text"), M.hash_embed(i, "id", "text"))
    return s.select(F.col("qid").alias("o_orderkey"), F.col("id").alias("p_partkey"), F.col("rk").cast("bigint").alias("rk"))


def label_centroids(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    per_dim = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("a"))
    return per_dim.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]).alias("vec")
    )


def memory_semantic_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest embeddings (cosine) to every label centroid."""
    q = label_centroids(spark, sf).select(F.col("label").alias("qid"), "vec")
    items = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return M.vector_top_k(q, items).select(F.col("qid").alias("label"), F.col("id").alias("vec_id"), F.col("rk").cast("bigint").alias("rk"))


def hash_embed_memories(spark: SparkSession, sf: str) -> DataFrame:
    m = M.hash_embed(memories(spark, sf), "id", "content")
    cells = m.select("id", F.posexplode("vec").alias("b", "x")).where(F.col("x") != 0)
    return cells.select("id", F.col("b").cast("bigint").alias("b"), F.round("x", 6).alias("x"))


def _semantic_hash(spark: SparkSession, sf: str, mem: DataFrame) -> DataFrame:
    return M.vector_top_k(M.hash_embed(recall_queries(spark, sf), "qid", "text"), M.hash_embed(mem, "id", "content"))


def memory_semantic_hash(spark: SparkSession, sf: str) -> DataFrame:
    s = _semantic_hash(spark, sf, memories(spark, sf))
    return s.select(F.col("qid").alias("conv_id"), "id", F.col("rk").cast("bigint").alias("rk"))


def _selected(spark: SparkSession, sf: str) -> DataFrame:
    mem = memories(spark, sf)
    kw = M.recall(recall_queries(spark, sf), mem)
    sem = _semantic_hash(spark, sf, mem)
    return M.select_injectable(M.fuse(kw, sem), mem)


def memory_fuse_budget(spark: SparkSession, sf: str) -> DataFrame:
    s = _selected(spark, sf)
    return s.select(F.col("qid").alias("conv_id"), "id", "rank", F.col("used").cast("bigint").alias("used"))


def memory_block(spark: SparkSession, sf: str) -> DataFrame:
    return M.memory_block(_selected(spark, sf)).select(F.col("qid").alias("conv_id"), "block")


def recall_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every event recalls a memory: the benchmark item of the user's id, modulo the number of items."""
    items = memories(spark, sf).select("id", "item_id")
    n = items.agg(F.count(F.lit(1)).alias("n_items"))  # one row
    ev = table(spark, sf, "events").crossJoin(F.broadcast(n)).withColumn("item_id", F.pmod("user_id", F.greatest("n_items", F.lit(1))))
    return ev.join(items, "item_id").select("id", epoch_millis(F.col("ts")).alias("ts_ms"), F.col("event_id").alias("ev"))


def _promoted(spark: SparkSession, sf: str) -> DataFrame:
    return M.record_recalls(memories(spark, sf).drop("item_id"), recall_events(spark, sf))


def memory_promote(spark: SparkSession, sf: str) -> DataFrame:
    return _promoted(spark, sf).select("id", "recall_count", "accessed_ms", "promoted", "promoted_at_ms")


def memory_export(spark: SparkSession, sf: str) -> DataFrame:
    return M.export_lines(_promoted(spark, sf))


def memory_list(spark: SparkSession, sf: str) -> DataFrame:
    return M.list_memories(memories(spark, sf)).select("list_rank", "id", "content", "kind", "egress_policy", "created_ms")


def memory_local_terms(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).where(F.col("egress_policy") == "local_only").select("content")


def memory_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Delete memories of items flagged toxic in labels; list what remains."""
    mem = memories(spark, sf)
    flagged = table(spark, sf, "labels").where(F.col("toxic") == 1)
    gone = mem.join(flagged, mem["item_id"] == flagged["doc_id"], "left_semi").select("id")
    return M.delete_memories(mem, gone).select("id", "created_ms")


def memory_json(spark: SparkSession, sf: str) -> DataFrame:
    m = memories(spark, sf)
    return m.select("id", F.to_json(F.struct("id", "content", "kind", "egress_policy", "created_ms")).alias("json"))
