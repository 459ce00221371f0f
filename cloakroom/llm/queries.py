"""The registered queries of this package (thin: each applies its operator to whole tables)."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cloakroom.llm import circulant_minhash, fingerprints, language_id, merkle, ngram_join, oracles, packing, pii_pseudonyms, sentencepiece_codec, substring_dedup, suffix_dedup, toxicity, vector_search, whitening
from cloakroom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "embeddings"), vector_search.every(20), 20)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"))


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_pseudonyms.pseudonymize_documents(table(spark, sf_dir, "documents"), pii_pseudonyms.session_key(spark))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_windows(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents")).drop("row_key")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.prove_documents(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], merkle.without_newlines())


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_best_fit_packing, op2_vector_search, op3_language_id, op4_sentencepiece, op5_fingerprints, op6_toxicity, op7_suffix_dedup, op8_pii_pseudonyms, op9_substring_dedup, op10_ngram_join, op11_merkle_manifest, op12_whitening, op13_circulant_minhash)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
