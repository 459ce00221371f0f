"""Registered queries over stores and dialect conversions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakroom.operators.dialect import to_block_response, to_canonical_request
from cloakroom.session import checkpoint_dir
from cloakroom.sources import store
from cloakroom.sources.tables import table
from cloakroom.sources.vocab import vocab_terms


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def memory_insert(spark: SparkSession, sf: str) -> DataFrame:
    """A memory table of an older schema, opened, and every user turn inserted twice (the second adds nothing)."""
    from cloakroom.plans.memory_queries import BASE_MS, memories

    base = _folder(spark, "memories")
    store.append(memories(spark, sf).select("id", "content", "kind", "egress_policy", "created_ms"), base)
    turns = table(spark, sf, "conversations").where("role = 'user'")
    new = turns.select(
        F.col("text").alias("content"), F.lit(" note ").alias("kind"),
        F.when(F.col("turn") % 2 == 1, F.lit("Local")).otherwise(F.lit("")).alias("egress_policy"),
        (F.lit(BASE_MS) + F.col("conv_id") * 1000 + F.col("turn")).cast("bigint").alias("created_ms"),
    )
    for _ in range(2):
        store.append(store.insert_memories(store.open_table(spark, base, store.MEMORY_SCHEMA), new), base)
    return store.open_table(spark, base, store.MEMORY_SCHEMA).select("id", "content", "kind", "egress_policy", "created_ms", "recall_count", "accessed_ms")


def vocabulary_files(spark: SparkSession, sf: str) -> DataFrame:
    """Terms from a list and from files of customer names (some lines are comments or blank), in order."""
    base = _folder(spark, "terms")
    k = F.col("c_custkey")
    line = F.when(k % 10 == 8, F.concat(F.lit("# "), "c_name")).when(k % 10 == 9, F.lit("  ")).otherwise(F.concat(F.lit(" "), "c_name"))
    c = table(spark, sf, "customer").select(k, line.alias("line"))
    c.repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey").select("line").write.text(base)
    return vocab_terms(spark, "first term, second ,,", [base]).select(F.col("ins").cast("bigint").alias("ins"), "term")


def outbound_recalls(spark: SparkSession, sf: str) -> DataFrame:
    """The memories that the outbound job recalled, with their new counts."""
    from cloakroom.plans.outbound import recalls_of_conversations

    m = recalls_of_conversations(spark, sf)
    return m.where("recall_count > 0").select("id", "recall_count", "promoted")


def canonical_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Block-dialect bodies with tools and sampling fields as canonical requests."""
    from cloakroom.plans.chat_queries import block_dialect_requests

    b = block_dialect_requests(spark, sf)
    more = F.concat(F.lit('{"max_tokens":'), (F.col("conv_id") % 100).cast("string"), F.lit(',"stop_sequences":["x"],"tools":[{"name":"lookup","description":"d"}],'), F.substring("body", 2, 1 << 30))
    v = F.try_parse_json(to_canonical_request(more))
    r = b.select("conv_id", v.alias("v"))
    at = lambda p, kind: F.try_variant_get("v", p, kind)
    return r.select(
        "conv_id", at("$.model", "string").alias("model"), F.size(at("$.messages", "array<variant>")).cast("bigint").alias("n_messages"),
        at("$.max_tokens", "bigint").alias("max_tokens"), F.to_json(at("$.stop", "variant")).alias("stop"),
        at("$.tools[0].function.name", "string").alias("tool"), F.to_json(at("$.tools[0].function.parameters", "variant")).alias("parameters"),
    )


def block_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical responses made of orders (a text, a tool call, a cut-off text) as block-dialect responses."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    text = F.concat(F.lit('"order '), k.cast("string"), F.lit('"'))
    call = F.concat(F.lit('[{"id":"c1","function":{"name":"lookup","arguments":"{\\"order\\":'), k.cast("string"), F.lit('}"}}]'))
    message = F.when(k % 3 == 1, F.concat(F.lit('{"content":null,"tool_calls":'), call, F.lit("}"))).otherwise(F.concat(F.lit('{"content":'), text, F.lit("}")))
    finish = F.when(k % 3 == 0, F.lit("stop")).when(k % 3 == 1, F.lit("tool_calls")).otherwise(F.lit("length"))
    resp = F.concat(F.lit('{"choices":[{"message":'), message, F.lit(',"finish_reason":"'), finish, F.lit('"}],"usage":{"completion_tokens":'), (k % 50).cast("string"), F.lit("}}"))
    v = F.try_parse_json(to_block_response(resp))
    r = o.select("o_orderkey", v.alias("v"))
    at = lambda p, kind="string": F.try_variant_get("v", p, kind)
    return r.select(
        "o_orderkey", at("$.stop_reason").alias("stop_reason"), at("$.content[0].type").alias("kind"), at("$.content[0].text").alias("text"),
        at("$.content[0].input.order").alias("order_arg"), at("$.usage.output_tokens", "bigint").alias("output_tokens"),
    )
