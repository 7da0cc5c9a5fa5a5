"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's input.

quality -> toxicity -> near duplicates -> decontamination -> tokens. Rows that a stage rejects are gone from all later
ones; all but the last stage return the columns of ``documents``.

Edge cases of every stage: rows are told apart by a hash of id and text, not by their id, so rows that share an id, or
have none, are judged each for itself; null and empty texts are rejected by the quality stage; further columns are kept,
whatever their names; an empty table gives an empty table; whole texts are judged, however long.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import byte_bpe, decontamination, importance, near_duplicates, toxicity
from feedloom.llm.arrow import KEY, except_rows, kept_apart
from feedloom.shared import remove, shared_dir, ship, written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; rows that are equal in id and text are drawn alike."""
    gone = written(importance.resample(docs, _labels(spark, sf_dir)).where("NOT kept").select(*KEY).distinct(), "not-drawn")
    return except_rows(kept_apart(docs), gone).select("doc.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names that clash with none of the classifier's
    found = toxicity.classify(plain, _labels(spark, sf_dir), *[f"c{docs.columns.index(x)}" for x in ("doc_id", "text")])
    return found.where("NOT is_toxic").select(*plain.columns).toDF(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more): that of the smallest id,
    and one row of those that are equal."""
    return near_duplicates.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with benchmark passages."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the digests of ids and decoded text."""
    return byte_bpe.digests(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", toxic),
    ("near_duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("tokens", tokens),
]

#: Models and MinHash have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the table of a stage is deleted when the next one is written."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before:
            remove(spark, before)
        before = f"{top}/{name}"
    return docs
