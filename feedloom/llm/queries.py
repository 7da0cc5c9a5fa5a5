"""The registered queries of this subpackage: thin calls of its operators on the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import byte_bpe, conversations, decontamination, importance, language_id, licenses, main_text, near_duplicates, neighbours, periodic_runs, spot_signatures, token_files, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digests(documents, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(documents, table(spark, sf_dir, "labels")).drop("text")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.round_trip(documents, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(documents, public_tokenizers.path("piece_bpe_32k.model"))


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(documents, table(spark, sf_dir, "labels")).drop("row", "row2")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op8_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(embeddings, "vec_id % 100 = 0")


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates.near_duplicates(documents, size=3, numerator=85, denominator=100)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(table(spark, sf_dir, "conversations"))


def op12_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_signatures.compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_token_files": op3_token_files,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_importance_resampling": op6_importance_resampling,
    "op7_main_text": op7_main_text,
    "op8_learned_partitions": op8_learned_partitions,
    "op9_licence_scan": op9_licence_scan,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spot_signatures": op12_spot_signatures,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": decontamination.oracle(),
    "op9_licence_scan": licenses.oracle(),
    "op11_conversation_repair": conversations.oracle(),
    "op12_spot_signatures": spot_signatures.oracle(),
}
