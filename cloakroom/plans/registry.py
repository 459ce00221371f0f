"""Name -> query (spark, sf_dir) -> DataFrame, and name -> DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cloakroom.plans import detection as det
from cloakroom.plans import memory_queries as mq
from cloakroom.plans import vault_queries as vq
from cloakroom.plans import stream_queries as sq
from cloakroom.plans import chat_queries as cq
from cloakroom.plans import outbound as ob
from cloakroom.plans import store_queries as st
from cloakroom.plans.oracles import chat_field_oracles, sanitized_request_oracles, chat_oracles, discovered_oracles, joined_gazetteer_oracles, outbound_oracles, store_oracles, detection_oracles, dialect_oracles, memory_oracles, vault_oracles

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "detect_email": det.detect_email,
        "detect_credit_card": det._pattern_query("credit_card"),
        "detect_ip_address": det._pattern_query("ip_address"),
        "detect_phone": det._pattern_query("phone"),
        "detect_ids": det.detect_ids,
        "detect_entropy": det.detect_entropy,
        "detect_floor": det.detect_floor,
        "detect_floor_pages": det.detect_floor_pages,
        "detect_gazetteer": det.detect_gazetteer,
        "detect_customer_names": det.detect_customer_names,
        "detect_gazetteer_joined": det.detect_gazetteer_joined,
        "intern_session_vault": det.intern_session_vault,
        "anonymize_documents": det.anonymize_documents,
        "audit_by_kind": det.audit_by_kind,
        "rehydrate_roundtrip": det.rehydrate_roundtrip,
        "egress_guard_blocked": det.egress_guard_blocked,
        "leak_audit_documents": det.leak_audit_documents,
        "anonymize_null_keys": det.anonymize_null_keys,
        "vault_leaks_documents": det.vault_leaks_documents,
        "chat_gather_text": mq.chat_gather_text,
        "memory_recall_bm25": mq.memory_recall_bm25,
        "memory_recall_all_words": mq.memory_recall_all_words,
        "memory_semantic_orders": mq.memory_semantic_orders,
        "memory_semantic_topk": mq.memory_semantic_topk,
        "hash_embed_memories": mq.hash_embed_memories,
        "memory_semantic_hash": mq.memory_semantic_hash,
        "memory_fuse_budget": mq.memory_fuse_budget,
        "memory_block": mq.memory_block,
        "memory_promote": mq.memory_promote,
        "memory_export": mq.memory_export,
        "memory_list": mq.memory_list,
        "memory_local_terms": mq.memory_local_terms,
        "memory_delete": mq.memory_delete,
        "memory_json": mq.memory_json,
        "vault_lookup_keys": vq.vault_lookup_keys,
        "vault_seal_roundtrip": vq.vault_seal_roundtrip,
        "durable_vault_increment": vq.durable_vault_increment,
        "durable_vault_keyed": vq.durable_vault_keyed,
        "anonymize_degraded": vq.anonymize_degraded,
        "layered_rehydrate": vq.layered_rehydrate,
        "stream_rehydrate": sq.stream_rehydrate,
        "stream_deltas": sq.stream_deltas,
        "stream_anonymize": sq.stream_anonymize,
        "stream_anonymize_restore": sq.stream_anonymize_restore,
        "rescue_tool_calls": cq.rescue_tool_calls,
        "llm_reply_terms": cq.llm_reply_terms,
        "anonymize_with_discovered": cq.anonymize_with_discovered,
        "prepare_outbound_conversations": ob.prepare_outbound_conversations,
        "eval_outcomes": cq.eval_outcomes,
        "eval_report": cq.eval_report,
        "eval_report_lines": cq.eval_report_lines,
        "eval_requests": cq.eval_requests,
        "route_candidates": cq.route_candidates,
        "normalize_transcripts": cq.normalize_transcripts,
        "chat_fields_anonymize": cq.chat_fields_anonymize,
        "chat_requests_sanitized": cq.chat_requests_sanitized,
        "reply_restore_roundtrip": cq.reply_restore_roundtrip,
        "memory_insert": st.memory_insert,
        "vocabulary_files": st.vocabulary_files,
        "outbound_recalls": st.outbound_recalls,
        "canonical_requests": st.canonical_requests,
        "block_responses": st.block_responses,
        "guard_chat_requests": cq.guard_chat_requests,
        "deep_tool_descriptions": cq.deep_tool_descriptions,
        "rescue_multi_choice": cq.rescue_multi_choice,
    }
    return q


def _mem_cte() -> str:
    from cloakroom.plans.oracles import _memories_sql

    return _memories_sql()


def oracle_sql() -> dict[str, str]:
    o = {}
    o.update(detection_oracles())
    o.update(memory_oracles())
    o.update(vault_oracles())
    o["stream_rehydrate"] = o["rehydrate_roundtrip"]
    o["stream_deltas"] = (
        "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 3 AS VARCHAR) ELSE '0:' || CAST(doc_id % 5 AS VARCHAR) END AS slot, "
        f"CAST(CASE WHEN doc_id % 4 = 3 THEN 1 ELSE 2 END AS BIGINT) AS others, text FROM ({o['rehydrate_roundtrip']})"
    )
    o["stream_anonymize"] = o["anonymize_documents"]
    o["stream_anonymize_restore"] = (
        f"SELECT r.doc_id, r.text, coalesce(f.n, 0) AS redactions FROM ({o['rehydrate_roundtrip']}) r "
        f"LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({o['detect_floor']}) GROUP BY doc_id) f ON f.doc_id = r.doc_id"
    )
    o.update(chat_oracles())
    o.update(dialect_oracles())
    o.update(chat_field_oracles())
    o.update(sanitized_request_oracles())
    o.update(joined_gazetteer_oracles())
    o.update(discovered_oracles())
    o.update(outbound_oracles())
    o.update(store_oracles())
    o["memory_json"] = (
        "WITH " + _mem_cte() + " SELECT id, CAST(json_object('id', id, 'content', content, 'kind', kind, "
        "'egress_policy', egress_policy, 'created_ms', created_ms) AS VARCHAR) AS json FROM mem"
    )
    o["reply_restore_roundtrip"] = "SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv_id, true AS restored FROM conversations"
    return o
