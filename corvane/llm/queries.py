"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corvane.llm import byte_bpe, decontaminate, kneser_ney, language, lexical, licenses, manifest, near_text, near_vectors, pii, sharding, token_files, toxicity
from corvane.session import table


def op1_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.fit_and_score(table(spark, sf_dir, "documents"))


def op3_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return byte_bpe.round_trip(documents, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_character_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.fit_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), 8)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_and_read_back(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_texts(table(spark, sf_dir, "documents"))


def op11_merkle_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.prove_documents(table(spark, sf_dir, "documents"))


def op12_signature_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op13_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_cap_filters": op1_cap_filters,
        "op2_kneser_ney": op2_kneser_ney,
        "op3_bootstrapped_pii": op3_bootstrapped_pii,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_character_models": op5_character_models,
        "op6_string_tiling": op6_string_tiling,
        "op7_noisy_channel": op7_noisy_channel,
        "op8_bounded_ring": op8_bounded_ring,
        "op9_token_files": op9_token_files,
        "op10_order_minhash": op10_order_minhash,
        "op11_merkle_descent": op11_merkle_descent,
        "op12_signature_rules": op12_signature_rules,
        "op13_norm_buckets": op13_norm_buckets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle_descent": manifest.SQL, "op13_norm_buckets": lexical.SQL}
